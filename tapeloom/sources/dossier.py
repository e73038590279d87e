"""Sections of a company's page, as columns over its parsed tables and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.fundamentals import number
from tapeloom.operators.storage import classify

# The columns that tell a section's table, and those that it must not have.
SIGNATURES = {
    "quarters": (["EPS", "Revenue", "Quarter", "Q Date"], []),
    "annual": (["Financial Year", "EPS", "Report"], ["Q Date", "Quarter"]),
    "dividends": (["Announced", "Subject", "EX Date", "Payment Date"], []),
    "shareholding": (["Announced", "Date Change", "Type", "Shares", "Name"], []),
}
# Kinds of announcements in order; the first pattern that a title has, in lower case, decides.
ANNOUNCEMENTS = [
    ("dilution", r"private placement|rights issue|renounceable|placement of"),
    ("uma", r"unusual market activity|\buma\b"),
    ("results", r"quarterly report|quarterly rpt|financial report|annual report"),
    ("contract", r"contract|letter of award|\bloa\b|tender|memorandum of understanding|\bmou\b"),
    ("bonus_split", r"bonus issue|share split|subdivision"),
    ("esos", r"\besos\b|employees share|share option"),
    ("related_party", r"related party|\brpt\b"),
    ("insider_dealing", r"changes in sub|s-hldr|substantial shareholder|dealings? in securities|director'?s? interest|section 138|section 219"),
    ("capital", r"share buy-back|buyback|capital repayment|redemption"),
]
# How many entries a section keeps.
QUARTERS, YEARS, DIVIDENDS, MOVES = 12, 6, 6, 500
DATES = ("d MMM yyyy", "d MMMM yyyy", "yyyy-MM-dd", "d/M/yyyy")


def day(text: Column) -> Column:
    """A date as pages print it, commas ignored; null where it is none."""
    bare = F.trim(F.regexp_replace(text, ",", ""))
    return F.coalesce(*(F.try_to_timestamp(bare, F.lit(f)).cast("date") for f in DATES))


def figure(text: Column) -> Column:
    """A number as pages print it; dashes and words for nothing give null."""
    return F.when(~F.trim(text).isin("", "-", "nan", "N/A", "NA"), number(text))


def announcement_kind(title: Column) -> Column:
    return classify(F.lower(F.coalesce(title, F.lit(""))), ANNOUNCEMENTS, "other")


def picked(tables: Column, kind: str) -> Column:
    """The table that fits a section: of several that with most rows, of these the first; null if none fits.

    Rows whose cells all say one thing are banners that group others, and go.
    """
    need, deny = (F.array(*(F.lit(x) for x in names)).cast("array<string>") for names in SIGNATURES[kind])
    fits = F.filter(tables, lambda t: (F.size(F.array_except(need, t["header"])) == 0) & ~F.arrays_overlap(deny, t["header"]))
    best = F.array_max(F.transform(fits, lambda t, i: F.struct(F.size(t["rows"]).alias("n"), (-i).alias("i"), t.alias("t"))))["t"]
    rows = F.filter(best["rows"], lambda r: F.size(F.array_distinct(F.filter(r, lambda x: F.trim(x) != ""))) > 1)
    return F.when(best.isNotNull(), F.struct(best["header"].alias("header"), rows.alias("rows")))


def _cell(header: Column, row: Column, name: str) -> Column:
    at = F.array_position(header, name)
    return F.when(at > 0, F.get(row, (at - 1).cast("int")))


def _begins(header: Column, prefix: str) -> Column:
    """The first column name that begins so, or null."""
    return F.get(F.filter(header, lambda h: h.startswith(prefix)), F.lit(0))


def _scaled(header: Column, row: Column, prefix: str) -> Column:
    name = _begins(header, prefix)
    value = figure(F.get(row, (F.array_position(header, name) - 1).cast("int")))
    return F.when(F.contains(name, F.lit("'000")), value * 1000).otherwise(value)


def sections(pages: DataFrame) -> DataFrame:
    """Parsed pages with quarters, annual, dividends, moves, announcements, news and unavailable (which of quarters and annual a page lacks).

    Quarters are newest first, as printed; thousands are scaled. A page without any table raises no error here: all its
    sections are empty.
    """
    def rows(kind: str, limit: int, of) -> Column:
        def cut(t: Column) -> Column:
            return F.transform(F.slice(F.coalesce(t["rows"], F.array().cast("array<array<string>>")), 1, limit), lambda r: of(t["header"], r))

        # the table is bound as a lambda's variable: written into each cell's expression it would be picked for each cell
        return F.get(F.transform(F.array(picked(F.col("parsed.tables"), kind)), cut), F.lit(0))

    def quarter(h: Column, r: Column) -> Column:
        at = F.coalesce(day(_cell(h, r, "Q Date")), day(_cell(h, r, "Financial Year")))
        numbers = {"revenue": "Revenue", "net_income": "P/L", "eps": "EPS", "dps": "DPS", "nta": "NTA", "roe": "ROE"}
        return F.struct(at.alias("q_end"), day(_cell(h, r, "Announced")).alias("announced"), *(figure(_cell(h, r, name)).alias(k) for k, name in numbers.items()))

    def year(h: Column, r: Column) -> Column:
        return F.struct(day(_cell(h, r, "Financial Year")).alias("year_end"), _scaled(h, r, "Revenue").alias("revenue"), _scaled(h, r, "Net (").alias("net_income"), figure(_cell(h, r, "EPS")).alias("eps"))

    def dividend(h: Column, r: Column) -> Column:
        text = lambda name, n: F.substring(F.trim(F.coalesce(_cell(h, r, name), F.lit(""))), 1, n)
        return F.struct(day(_cell(h, r, "Announced")).alias("announced"), text("Subject", 120).alias("subject"), day(_cell(h, r, "EX Date")).alias("ex_date"), day(_cell(h, r, "Payment Date")).alias("payment_date"), text("Amount", 40).alias("amount"))

    def move(h: Column, r: Column) -> Column:
        name = F.substring(F.trim(F.coalesce(_cell(h, r, "Name"), F.lit(""))), 1, 80)
        kind = F.lower(F.trim(F.coalesce(_cell(h, r, "Type"), F.lit(""))))
        return F.struct(day(_cell(h, r, "Announced")).alias("d"), day(_cell(h, r, "Date Change")).alias("changed"), kind.alias("kind"), F.coalesce(figure(_cell(h, r, "Shares")), F.lit(0.0)).cast("long").alias("shares"), name.alias("name"))

    kept = F.filter(rows("quarters", QUARTERS, quarter), lambda q: q["q_end"].isNotNull() | q["revenue"].isNotNull() | q["net_income"].isNotNull())
    labelled = F.transform("parsed.announcements", lambda a: F.struct(a["item_id"].alias("item_id"), a["title"].alias("title"), a["url"].alias("url"), a["date"].alias("date"), announcement_kind(a["title"]).alias("category")))
    x = pages.withColumns({"quarters": kept, "annual": rows("annual", YEARS, year), "dividends": rows("dividends", DIVIDENDS, dividend), "moves": F.filter(rows("shareholding", MOVES, move), lambda m: m["d"].isNotNull()), "announcements": labelled, "news": F.col("parsed.news")})
    lacking = F.array_compact(F.array(*(F.when(F.size(k) == 0, F.lit(k)) for k in ("quarters", "annual"))))
    return x.withColumn("unavailable", lacking).drop("parsed")


def feed(pages: DataFrame, base: str) -> DataFrame:
    """One row per item of parsed feed pages: the pages' other columns, item_id, title, url (made whole by base), source, date as printed, and d where that is a day."""
    rest = [c for c in pages.columns if c != "parsed"]
    x = pages.select(*rest, F.explode("parsed.feed").alias("f"))
    whole = F.when(F.col("f.url").rlike(r"^[a-z]+://"), F.col("f.url")).otherwise(F.concat(F.lit(base), F.col("f.url")))
    return x.select(*rest, "f.item_id", "f.title", whole.alias("url"), "f.source", "f.date", F.substring(F.col("f.date"), 1, 10).try_cast("date").alias("d"))
