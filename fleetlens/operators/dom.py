"""HTML as nested intervals: elements are rows with a start and an end, and containment is a comparison of places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.functions import html as H, url as U
from fleetlens.operators.brackets import paired

#: Comments, tags and the text between them.
PIECE = r"(?s)<!--.*?-->|<[^>]*>|[^<]+"
TAG = r"^</?([a-zA-Z][a-zA-Z0-9]*)"
# Elements without an end tag. Fixed values.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
# Where the content of a page is looked for, in this order. Fixed values.
CONTENT = (("tag", "article"), ("tag", "main"), ("class", "entry-content"), ("class", "post-content"), ("id", "content"), ("class", "content"),
           ("tag", "body"))
STRIPPED = ("nav", "header", "footer", "aside", "form")


def elements(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, at, piece, name, step, level, stray, partner): the pieces of each page in order, tags paired by name.

    Scripts and styles are cut out before. An element without an end tag has no partner.
    """
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>", ""), r"(?is)<style\b.*?</style\s*>", "")
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(plain, F.lit(PIECE), F.lit(0))).alias("at", "piece"))
    name = F.lower(F.regexp_extract("piece", TAG, 1))
    named = rows.withColumn("name", name)
    step = F.when(F.col("name").isin("", *VOID), 0).when(F.col("piece").startswith("</"), -1).otherwise(1)
    return paired(named.withColumn("step", step).repartition(key), key, "name")


def _rank(selectors: Sequence[tuple[str, str]]) -> Column:
    """Which selector an opening tag answers first, null when none."""
    tokens = lambda a: F.split(F.lower(F.coalesce(H.attr(F.col("piece"), a), F.lit(""))), r"\s+")
    tests = {"tag": lambda v: F.col("name") == v, "class": lambda v: F.array_contains(tokens("class"), v), "id": lambda v: F.array_contains(tokens("id"), v)}
    return F.coalesce(*[F.when(tests[kind](value), F.lit(k)) for k, (kind, value) in enumerate(selectors)])


def main_content(pages: DataFrame, key: str, selectors: Sequence[tuple[str, str]] = CONTENT,
                 stripped: Sequence[str] = STRIPPED) -> DataFrame:
    """(key, title, h1, description, canonical, selector, headings, images, links, text) per page of (key, url, html).

    The content is the first element that answers the first selector anything
    answers; `stripped` elements inside it go. headings is array<struct<tag, text>>, images
    array<struct<src, alt>> and links array<string>, in page order, absolute where they
    resolve; text has its spaces collapsed.

    An element without an end tag reaches to the end of its page; an unclosed heading to
    the next heading. A page without any of the selectors, empty or null gives a row without content.
    Pieces are dealt out by page once, and every step sorts or adds up within pages.
    """
    named = F.when((F.col("step") == 1) & F.col("name").isNotNull(), _rank(selectors))
    whole, order = Window.partitionBy(key), Window.partitionBy(key).orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    end = F.coalesce("partner", F.lit(2 ** 31 - 1))
    rows = elements(pages, key).withColumn("rank", named)
    rows = rows.withColumn("main", F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "at", end.alias("end")))).over(whole))
    rows = rows.where((F.col("at") > F.col("main.at")) & (F.col("at") < F.col("main.end")))
    cut = F.col("name").isin(*stripped) & ~F.col("stray")
    heading = F.col("name").rlike("^h[1-6]$") & (F.col("step") == 1)
    rows = rows.withColumns({
        # An end tag still counts as inside, so the sum is read before it is taken off.
        "_cut": F.sum(F.when(cut, F.col("step")).otherwise(0)).over(so_far),
        "_heading": F.last(F.when(heading, F.struct("at", end.alias("end"))), ignorenulls=True).over(so_far)})
    kind = (F.when(heading, F.lit("heading")).when(F.col("name") == "img", F.lit("image"))
            .when((F.col("name") == "a") & (F.col("step") == 1), F.lit("link")).when(~F.col("piece").startswith("<"), F.lit("text")))
    inside = F.when(F.col("at") < F.col("_heading.end"), F.col("_heading.at"))
    kept = rows.where(F.col("_cut") == 0).withColumn("kind", kind).where("kind IS NOT NULL")
    item = F.struct("at", "kind", "name", "piece", inside.alias("heading"))
    items = kept.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    chosen = rows.groupBy(key).agg(F.min("main.rank").alias("rank"))

    here = F.coalesce(F.col("url"), F.lit(""))
    root = H.base_href(F.col("html"))
    facts = pages.select(
        key, F.coalesce(H.title(F.col("html")), F.lit("")).alias("title"),
        F.coalesce(F.try_element_at(H.inner_texts(F.col("html"), "h1"), F.lit(1)), F.lit("")).alias("h1"),
        F.coalesce(H.meta_content(F.col("html"), "description"), F.lit("")).alias("description"),
        F.coalesce(H.canonical(F.col("html")), F.lit("")).alias("canonical"),
        F.when(root.isNull(), here).otherwise(F.coalesce(U.resolve(here, root), here)).alias("base"))
    of = lambda k: F.filter("items", lambda i: i["kind"] == k)
    spaced = lambda t: H.decode_entities(F.trim(F.regexp_replace(t, r"\s+", " ")))
    joined = lambda some: spaced(F.array_join(F.transform(some, lambda i: i["piece"]), ""))

    def absolute(raw: Column) -> Column:
        return F.coalesce(U.resolve(F.col("base"), H.decode_entities(raw)), raw)

    headings = F.transform(of("heading"), lambda h: F.struct(
        h["name"].alias("tag"), joined(F.filter("items", lambda i: (i["kind"] == "text") & (i["heading"] == h["at"]))).alias("text")))
    filled = lambda array, field: F.filter(array, lambda v: F.coalesce(v[field] != "", F.lit(False)))
    images = filled(F.transform(of("image"), lambda i: F.struct(
        absolute(F.trim(H.attr(i["piece"], "src"))).alias("src"), F.coalesce(H.attr(i["piece"], "alt"), F.lit("")).alias("alt"))), "src")
    links = F.filter(F.transform(of("link"), lambda i: absolute(F.trim(H.attr(i["piece"], "href")))), lambda v: F.coalesce(v != "", F.lit(False)))
    labels = F.array(*[F.lit(value) for _, value in selectors])
    none = F.col("items").isNull()
    text = F.when(none, F.lit("")).otherwise(joined(of("text")))
    return facts.join(chosen, key, "left").join(items, key, "left").select(
        key, "title", "h1", "description", "canonical", F.get(labels, F.col("rank")).alias("selector"),
        headings.alias("headings"), images.alias("images"), links.alias("links"), text.alias("text"))
