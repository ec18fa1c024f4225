"""A categorisation round over the stored state: what to ask, what came back, what was decided."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtflow.operators import candidates, prompts, proposals, rules
from stmtflow.session import cut_lineage
from stmtflow.sources.store import SnapshotStore


class ReviewRound:
    """One step of a round. Steps that write (answers, approve, reject) each take a run id."""

    def __init__(self, store: SnapshotStore, run_id: str, now: datetime, model: str = ""):
        self.store, self.run_id, self.model = store, run_id, model
        self.at = F.lit(now).cast("timestamp")
        self._state = store.state(before=run_id)

    def uncategorised(self) -> DataFrame:
        return rules.uncategorized(self._state("budget_txn"), self._state("payee"), self._state("account"))

    def shortlist(self, limit: int = candidates.BATCH) -> DataFrame:
        excluded = candidates.excluded_payees(self._state("category_proposal"))
        return candidates.candidate_refs(candidates.candidates(self.uncategorised(), excluded, limit))

    def categories(self) -> DataFrame:
        return candidates.category_refs(
            candidates.visible_categories(self._state("category"), self._state("category_group"))
        )

    def examples(self, limit: int = candidates.EXAMPLES) -> DataFrame:
        taught = rules.rule_examples(self._state("rule"), self._state("payee"), self._state("category"))
        history = candidates.history_examples(
            self._state("budget_txn"), self._state("payee"), self._state("category"), taught
        )
        return candidates.categorization_examples(taught, history, limit)

    def prompt(self) -> DataFrame:
        return prompts.prompt(prompts.prompt_lines(self.categories(), self.examples(), self.shortlist()))

    def store_answers(self, answers: DataFrame) -> DataFrame:
        """``answers``: doc, json. Writes the review queue and returns why answers were dropped."""
        none = self._state("category_proposal").select("payee").limit(0)
        others = candidates.candidates(self.uncategorised(), none, limit=None)
        context = cut_lineage(proposals.with_others(self.shortlist(), others))
        resolved = cut_lineage(
            proposals.resolve(proposals.read_proposals(answers), context, self.categories())
        )
        valid = proposals.validate(resolved, context, self.model)
        queue = proposals.store(self._state("category_proposal"), valid, self.run_id, self.at)
        self.store.write(self.run_id, {"category_proposal": queue})
        return proposals.drop_reasons(resolved)

    def approve(self, ids: list[str], min_confidence: float | None = None, apply: bool = True) -> DataFrame:
        """Rules for the chosen proposals, and their category on rows that have none yet."""
        queue = self._state("category_proposal")
        chosen = proposals.select_proposals(queue, ids, min_confidence)
        made = cut_lineage(
            rules.new_rules(chosen.select("id", "payee", "category"), self._state("payee"), self._state("category"))
        )
        good = made.where("error is null")
        known = self._state("rule")
        last = known.agg(F.coalesce(F.max("rule_order"), F.lit(0))).first()[0]
        added = good.select(
            F.col("rule_id").alias("id"), F.lit(last + 1).alias("rule_order"), "conditions", "actions",
            F.lit(False).alias("tombstone"),
        ).join(known.select("id"), "id", "left_anti")  # a pair that was approved before has its rule
        tables = {
            "rule": known.unionByName(added),
            "category_proposal": proposals.decide(queue, good.select("id", "rule_id"), proposals.APPROVED, self.at),
        }
        filled = cut_lineage(
            rules.rule_backfill(self.uncategorised(), good).select("id", "new_category_id", "payee").dropDuplicates(["id"])
        )
        if apply:
            rows = self._state("budget_txn")
            tables["budget_txn"] = (
                rows.join(filled.drop("payee"), "id", "left")
                .withColumn("category_id", F.coalesce("new_category_id", "category_id"))
                .select(*rows.columns)
            )
        self.store.write(self.run_id, tables)
        counts = filled.groupBy("payee").agg(F.count(F.lit(1)).alias("applied_to"))
        return made.join(counts, "payee", "left").select(
            "id", "payee", "category", "rule_id", "error",
            F.coalesce("applied_to", F.lit(0)).alias("applied_to") if apply else F.lit(0).alias("applied_to"),
        )

    def reject(self, ids: list[str]) -> DataFrame:
        queue = self._state("category_proposal")
        chosen = cut_lineage(proposals.select_proposals(queue, ids).select("id", "payee"))
        decisions = chosen.select("id", F.lit(None).cast("string").alias("rule_id"))
        self.store.write(
            self.run_id, {"category_proposal": proposals.decide(queue, decisions, proposals.REJECTED, self.at)}
        )
        return chosen
