"""Bilingual accounting roles: which header of a table carries which concept."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import canonical_header

# The header synonyms of each concept.
SYNONYMS: dict[str, tuple[str, ...]] = {
    "account": ("konto", "kontonummer", "sachkontonummer", "lieferantenkontonummer", "kundenkontonummer",
                "kreditor", "debitor", "account", "accountno"),
    "account_name": ("name", "sachkontoname", "lieferantenname", "kundenname", "bezeichnung", "kreditorname",
                     "debitorname", "accountname"),
    "account_type": ("sachkontotyp", "kontenart", "kontoart", "accounttype", "typ"),
    "change_type": ("art", "aenderungsart", "changetype", "type"),
    "field_changed": ("feld", "field", "attribut"),
    "changed_by": ("geaendert_von", "erfasser", "ersteller", "changedby", "createdby", "angelegt_von",
                   "benutzer", "benutzerkennung", "user"),
    "approved_by": ("genehmigt_von", "freigeber", "approvedby", "approver", "genehmiger"),
    "approved_flag": ("genehmigt", "freigabe", "approved", "freigabestatus"),
    "amount": ("betrag", "betrag_eur", "buchungsbetrag", "summe", "summe_abs_eur", "amount", "buchungswert",
               "wert"),
    "currency": ("waehrung", "buchungswaehrung", "currency", "waehrungskennung"),
    "posting_date": ("buchungsdatum", "belegdatum", "datum", "wertstellung", "date", "postingdate",
                     "erfasst_am"),
    "invoice_date": ("fakturadatum", "rechnungsdatum", "belegdatum", "invoicedate"),
    "service_date": ("leistungsdatum", "servicedate", "wareneingang_datum", "lieferdatum"),
    "document_no": ("belegnummer", "dokument", "beleg", "rechnungsnummer", "referenz", "documentno",
                    "reference", "erfassungsnummer"),
    "payment_reference": ("dokument", "sammelbeleg", "sammel", "zahllaufnummer", "paymentref",
                          "batchreference", "zahlungsreferenz"),
    "posting_text": ("buchungstext", "bemerkung", "text", "verwendungszweck", "narrative"),
    "posting_kind": ("buchungstyp", "buchungsart", "postingtype", "kind"),
    "vendor": ("kreditor", "lieferantenkontonummer", "vendor", "supplier", "kreditornummer"),
    "asset_no": ("anlagennummer", "assetno", "assetnumber"),
    "asset_desc": ("anlagenbezeichnung", "assetdescription", "bezeichnung"),
    "asset_group": ("anlagengruppe", "assetgroup", "anlagenklasse"),
    "counter_account": ("gegenkonto", "counteraccount"),
    "goods_receipt_no": ("wareneingang_nr", "goodsreceiptno", "grno", "we_nr", "receiptno"),
    "permission_user": ("benutzer", "user", "benutzerkennung", "mitarbeiter", "userid"),
}


def resolve_column(columns: Sequence[str], concept: str) -> str | None:
    """First header, in table order, that stands for the concept; metadata only."""
    wanted = {canonical_header(s) for s in SYNONYMS.get(concept, (concept,))}
    return next((c for c in columns if canonical_header(c) in wanted), None)


def resolves_all(columns: Sequence[str], concepts: Iterable[str]) -> bool:
    return all(resolve_column(columns, c) is not None for c in concepts)


def role_view(df: DataFrame, concepts: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Select the columns of the wanted concepts under their concept names.

    A plain select, so pruning still reaches the scan. Concepts the table lacks are NULL text.
    """
    chosen = []
    for concept in concepts:
        header = resolve_column(df.columns, concept)
        chosen.append((F.col(f"`{header}`") if header else F.lit(None).cast("string")).alias(concept))
    return df.select(*chosen, *[F.col(f"`{k}`") for k in keep])
