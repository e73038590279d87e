"""A securities registry's documents: the ticker map, company facts, filings with their item codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.sources.vendor import MATERIAL

# Category by item code.
ITEM_KINDS = {
    "1.01": "contract",
    "1.02": "contract",
    "1.03": "bankruptcy",
    "2.01": "acquisition",
    "2.02": "results",
    "2.03": "capital",
    "2.04": "capital",
    "2.05": "restructuring",
    "2.06": "impairment",
    "3.01": "delisting_risk",
    "3.02": "dilution",
    "3.03": "dilution",
    "4.01": "auditor_change",
    "4.02": "restatement",
    "5.01": "control_change",
    "5.02": "management",
    "5.07": "agm",
    "7.01": "disclosure",
    "8.01": "other_event",
}
# Category by form.
FORM_KINDS = {
    "10-Q": "results", "10-K": "results", "20-F": "results", "40-F": "results",
    "4": "insider_dealing", "3": "insider_dealing", "5": "insider_dealing",
    "SC 13D": "insider_dealing", "SC 13D/A": "insider_dealing",
    "SC 13G": "insider_dealing", "SC 13G/A": "insider_dealing",
    "144": "insider_selling",
    "S-1": "dilution", "S-3": "dilution", "S-3ASR": "dilution",
    "424B5": "dilution", "424B3": "dilution", "424B4": "dilution",
    "DEF 14A": "agm", "8-A12B": "listing",
}
# What an item code says.
ITEM_TITLES = {
    "1.01": "Entered a material definitive agreement",
    "1.02": "Terminated a material definitive agreement",
    "1.03": "Bankruptcy or receivership",
    "2.01": "Completed an acquisition or disposition",
    "2.02": "Results of operations (earnings release)",
    "2.03": "Created a direct financial obligation",
    "2.04": "Triggering event accelerating an obligation",
    "2.05": "Exit or disposal costs",
    "2.06": "Material impairment",
    "3.01": "Delisting notice / listing-rule failure",
    "3.02": "Unregistered sale of equity securities",
    "3.03": "Material modification to shareholder rights",
    "4.01": "Changed certifying accountant",
    "4.02": "Non-reliance on previously issued financials",
    "5.01": "Change in control",
    "5.02": "Director/officer departure or appointment",
    "5.07": "Shareholder vote results",
    "7.01": "Regulation FD disclosure",
    "8.01": "Other event",
}
# Titles of forms without items, items that say nothing alone, filings kept for a ticker.
FORM_TITLES = {"10-Q": "10-Q Quarterly report", "10-K": "10-K Annual report", "4": "Form 4 Insider transaction", "144": "Form 144 Proposed insider sale"}
IGNORED = ("9.01",)
FILINGS = 30
SUBMISSION = "name string, sicDescription string, exchanges array<string>, filings struct<recent: struct<accessionNumber: array<string>, form: array<string>, items: array<string>, filingDate: array<string>, primaryDocument: array<string>>>"


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def ticker_map(documents: DataFrame, raw: str = "raw") -> DataFrame:
    """ticker (upper case) and cik of the registry's map documents; of a ticker listed twice the entry that stands last counts."""
    entries = F.map_entries(F.from_json(raw, "map<string, struct<cik_str: long, ticker: string, title: string>>"))
    x = documents.select(F.posexplode(entries).alias("place", "e")).filter("e.value.ticker <> ''")
    return x.groupBy(F.upper("e.value.ticker").alias("ticker")).agg(F.max_by("e.value.cik_str", "place").alias("cik"))


def with_cik(tickers: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of tickers with their cik, null where the registry has none; those of .KL never have one, and a class is written with a hyphen there."""
    key = F.when(~F.col("ticker").endswith(".KL"), F.replace(F.upper("ticker"), F.lit("."), F.lit("-")))
    return tickers.withColumn("_key", key).join(known.select(F.col("ticker").alias("_key"), "cik"), "_key", "left").drop("_key")


def _read(submissions: DataFrame, raw: str) -> DataFrame:
    return submissions.select("cik", F.from_json(raw, SUBMISSION).alias("s"))


def companies(tickers: DataFrame, known: DataFrame, submissions: DataFrame, raw: str = "raw") -> DataFrame:
    """ticker, cik, name, industry, exchange (the first) of tickers that the registry knows and has a document of."""
    facts = _read(submissions, raw).select("cik", F.col("s.name").alias("name"), F.col("s.sicDescription").alias("industry"), F.get("s.exchanges", F.lit(0)).alias("exchange"))
    return with_cik(tickers.select("ticker"), known).join(facts, "cik").select("ticker", "cik", "name", "industry", "exchange")


def filing_title(form: Column, codes: Column) -> Column:
    """What the item codes say, ignored ones left out; else the form's own title."""
    said = F.filter(F.transform(F.filter(codes, lambda c: ~c.isin(*IGNORED)), lambda c: _looked_up(ITEM_TITLES, c)), lambda t: t.isNotNull())
    return F.when(F.size(said) > 0, F.concat(form, F.lit(": "), F.array_join(said, "; "))).otherwise(F.coalesce(_looked_up(FORM_TITLES, form), form))


def filing_kind(form: Column, codes: Column) -> Column:
    """The category of the first item code that has one, else of the form, else other."""
    first = F.get(F.filter(F.transform(codes, lambda c: _looked_up(ITEM_KINDS, c)), lambda k: k.isNotNull()), F.lit(0))
    return F.coalesce(first, _looked_up(FORM_KINDS, form), F.lit("other"))


def filings(tickers: DataFrame, known: DataFrame, submissions: DataFrame, base: str, forms: tuple[str, ...] | None = MATERIAL, limit: int = FILINGS, raw: str = "raw") -> DataFrame:
    """The first limit filings of each ticker in its document's order: ticker, item_id, form, title, category, url, filed, codes.

    The document's parallel arrays become rows; a shorter array ends with nulls. base is the registry's address.
    """
    lists = F.arrays_zip(*(F.col(f"s.filings.recent.{c}").alias(c) for c in ("accessionNumber", "form", "items", "filingDate", "primaryDocument")))
    x = with_cik(tickers.select("ticker"), known).join(_read(submissions, raw), "cik").select("ticker", "cik", F.posexplode(lists).alias("place", "f"))
    x = x.select("ticker", "cik", "place", F.col("f.accessionNumber").alias("item_id"), F.coalesce("f.form", F.lit("")).alias("form"), F.coalesce("f.items", F.lit("")).alias("items"), F.col("f.filingDate").alias("filed"), F.coalesce("f.primaryDocument", F.lit("")).alias("document"))
    x = x.filter("item_id is not null")
    if forms:
        x = x.filter(F.col("form").isin(*forms))
    codes = F.filter(F.transform(F.split("items", ","), lambda c: F.trim(c)), lambda c: c != "")
    link = F.concat(F.lit(base), F.lit("/Archives/edgar/data/"), F.col("cik").cast("string"), F.lit("/"), F.replace("item_id", F.lit("-"), F.lit("")), F.lit("/"), F.col("document"))
    listing = F.concat(F.lit(base), F.lit("/cgi-bin/browse-edgar?action=getcompany&CIK="), F.col("cik").cast("string"))
    x = x.withColumn("codes", codes).withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy("place"))).filter(F.col("k") <= limit)
    return x.select("ticker", "item_id", "form", filing_title(F.col("form"), F.col("codes")).alias("title"), filing_kind(F.col("form"), F.col("codes")).alias("category"), F.when(F.col("document") != "", link).otherwise(listing).alias("url"), F.col("filed").try_cast("date").alias("filed"), "codes")
