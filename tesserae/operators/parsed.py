"""Chunks of parsed documents: nested items with their places on pages, read as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The page size where a page has none (points), labels that begin a chapter, and those that are numbered.
WIDTH, HEIGHT = 595.0, 842.0
HEADINGS, NUMBERED = ("section_header", "title", "heading"), ("paragraph", "text")

_PROV = "array<struct<page_no:int,bbox:struct<l:double,r:double,t:double,b:double,coord_origin:string>>>"


def _table(rows: Column) -> Column:
    """Rows of cells as a table of markdown, the first row as its head; null without rows."""
    lines = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(r, " | ", ""), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(rows[0])))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, 1 << 30)), "\n"))


def _positions(prov: Column, pages: Column) -> Column:
    """[page, left, right, top, bottom] of each place, as shares of the page from its top left corner."""
    share = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))

    def place(p: Column) -> Column:
        page, box = pages[p["page_no"].cast("string")], p["bbox"]
        wide, high = F.coalesce(page["width"], F.lit(WIDTH)), F.coalesce(page["height"], F.lit(HEIGHT))
        below = F.contains(F.upper(F.coalesce(box["coord_origin"], F.lit("BOTTOMLEFT"))), F.lit("BOTTOMLEFT"))
        top, bottom = F.when(below, high - box["t"]).otherwise(box["t"]), F.when(below, high - box["b"]).otherwise(box["b"])
        return F.array(p["page_no"].cast("double"), share(box["l"] / wide), share(box["r"] / wide), share(F.least(top, bottom) / high), share(F.greatest(top, bottom) / high))

    return F.transform(prov, place)


def parsed_chunks(docs: DataFrame, id_col: str = "id", json_col: str = "parsed") -> DataFrame:
    """(id, order, text, element_type, chapter, physical_page, printed_page, paragraph_number, positions) of documents parsed to JSON:
    {"pages": {"1": {"width", "height"}}, "items": [{"kind", "label", "text" | "rows" | "caption", "prov": [{"page_no", "bbox"}]}]}.

    Items are numbered before those without text are left out, so the order has gaps. The chapter is the last heading up to the
    item. A page is that of the item's last place, 0 without any; the printed page is the same. Paragraphs are numbered on each page.
    A picture without a caption says so, an item of an unknown kind needs a text. JSON that can't be read has no chunks.
    """
    v = F.try_parse_json(F.col(json_col))
    pages = F.variant_get(v, "$.pages", "map<string,struct<width:double,height:double>>")
    # Two steps: next to an explode in one select, the pages would be read from the whole JSON again for each item.
    whole = docs.select(F.col(id_col).alias("id"), pages.alias("pages"), F.variant_get(v, "$.items", "array<variant>").alias("items"))
    items = whole.select("id", "pages", F.posexplode("items").alias("order", "item"))
    at = lambda path, kind: F.try_variant_get("item", path, kind)
    kind, said = at("$.kind", "string"), at("$.text", "string")
    text = F.when(kind == "table", _table(at("$.rows", "array<array<string>>"))).when(kind == "picture", F.coalesce(at("$.caption", "string"), F.concat(F.lit("[Picture "), F.col("order").cast("string"), F.lit("]")))).otherwise(said)
    label = F.when(kind == "text", F.coalesce(at("$.label", "string"), F.lit("text"))).otherwise(kind)
    prov = F.filter(F.coalesce(at("$.prov", _PROV), F.array().cast(_PROV)), lambda p: p["page_no"].isNotNull() & p["bbox"].isNotNull())
    page = F.coalesce(F.try_element_at("prov", F.lit(-1))["page_no"], F.lit(0))
    one = items.select("id", "order", "pages", text.alias("text"), label.alias("element_type"), (kind == "text").alias("plain"), prov.alias("prov"))
    one = one.select("id", "order", "text", "element_type", "plain", page.alias("physical_page"), _positions(F.col("prov"), F.col("pages")).alias("positions"))
    before = Window.partitionBy("id").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    chapter = F.last(F.when(F.col("plain") & F.col("element_type").isin(*HEADINGS), F.col("text")), ignorenulls=True).over(before)
    kept = one.select("id", "order", "text", "element_type", chapter.alias("chapter"), "physical_page", F.col("physical_page").alias("printed_page"), "positions")
    kept = kept.where(F.length(F.trim(F.regexp_replace("text", r"(?U)\s+", " "))) > 0)
    numbered = F.col("element_type").isin(*NUMBERED)
    count = F.count_if(numbered).over(Window.partitionBy("id", "physical_page").orderBy("order").rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumn("paragraph_number", F.when(numbered, count))
