"""Statement files with invented content."""

from pathlib import Path

HEADER = (
    "Buchungstag;Wert;Umsatzart;Begünstigter / Auftraggeber;Verwendungszweck;IBAN / Kontonummer;BIC;"
    "Kundenreferenz;Mandatsreferenz;Gläubiger ID;Fremde Gebühren;Betrag;Abweichender Empfänger;"
    "Anzahl der Aufträge;Anzahl der Schecks;Soll;Haben;Währung"
)


def bank_row(day, kind, name, purpose, iban="", reference="", amount="", debit="", credit="", currency="EUR"):
    cells = [day, day, kind, name, purpose, iban, "BICXXX", reference, "", "", "", amount, "", "", "", debit, credit, currency]
    return ";".join(cells)


PREAMBLE = [
    "Umsätze;;;",
    "Konto;DE00 0000 0000 0000 0000 00;;",
    "Inhaber;Erika Beispiel;;",
    ";;;",
    "Zeitraum;01.02.2026 - 28.02.2026;;",
    "Letzter Kontostand;;;;1.204,56;EUR;;",
    "Hinweis;Vorgemerkte Zeilen zählen nicht;;",
]
ROWS = [
    bank_row("3.2.2026", "SEPA-Lastschrift", "Stadtwerke Probe", "Abschlag Februar Nr 12345", "DE00 3333 3333 3333 3333 33", debit="-75,00"),
    bank_row("6.2.2026", "Kartenzahlung", "Bäckerei Probe", "Kauf 05.02.2026", debit="-4,20"),
    bank_row("6.2.2026", "Kartenzahlung", "Bäckerei Probe", "Kauf 05.02.2026", debit="-4,20"),
    bank_row("13.2.2026", "Gutschrift", "Firma Probe AG", "Gehalt 02/2026", "DE00 4444 4444 4444 4444 44", "E2E-7", credit="2.500,00"),
    bank_row("27.2.2026", "Vorgemerkt Kartenzahlung", "Markt Probe", "Kauf 27.02.2026", debit="-42,10"),
]
FOOTER = ["Kontostand am 28.02.2026;;;;1.204,56;EUR"]


def bank_text(rows=ROWS, preamble=PREAMBLE, header=HEADER, footer=FOOTER):
    return "\r\n".join([*preamble, header, *rows, *footer]) + "\r\n"


def write(folder: Path, name: str, text: str, encoding: str = "utf-8-sig") -> Path:
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return path
