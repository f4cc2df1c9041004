"""Line tables: synthetic geometry, repeated headers and footers, paragraphs.

A line table has book_id, page_num, line_no, text, y0, y1, font_size, page_height (and
page_width, x0, x1). A book's lines are shuffled by book once; pages and norms are
sub-keys, so later windows need no further exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

PAGE = ["book_id", "page_num"]


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys of which null equals null, so that rows without a book aren't lost."""
    named = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


def txt_lines(books: DataFrame, page_num: int = 1) -> DataFrame:
    """(book_id, text) -> lines with the geometry of one tall page; blank lines advance y."""
    parts = F.split(T.normalize_whitespace("text"), "\n")
    # a text is split and counted before it becomes lines: next to the generator it would be done again for
    # every line, and in a filter that Spark infers for an array column, which a call isn't
    split = books.select("book_id", parts.alias("parts")).select("book_id", F.size("parts").alias("n"), "parts")
    rows = split.select("book_id", "n", F.posexplode(F.coalesce("parts", F.array().cast("array<string>"))).alias("line_no", "text"))
    rows = settled(rows, {"text": T.clean_line("text")})
    y = 30.0 + 18.0 * F.col("line_no")
    out = rows.select(
        "book_id", F.lit(page_num).alias("page_num"), "line_no", "text", F.lit(50.0).alias("x0"), F.lit(550.0).alias("x1"), y.alias("y0"), (y + 12).alias("y1"),
        F.lit(12.0).alias("font_size"), F.lit(600.0).alias("page_width"), F.greatest(F.lit(800.0), 14.0 * F.col("n") + 40).alias("page_height"),
    )
    return out.where("text != ''")


def with_index(lines: DataFrame) -> DataFrame:
    """global_index: 0, 1, ... in a book, by page and line. Lines are numbered within their page,
    and pages get the running sum of the lines before, so only a book's page counts are in one
    task and never its lines."""
    before = Window.partitionBy("book_id").orderBy("page_num").rowsBetween(Window.unboundedPreceding, -1)
    pages = lines.groupBy(*PAGE).agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy("line_no"))
    return matched(lines.withColumn("place", place), pages.drop("n"), PAGE).withColumn("global_index", (F.col("ahead") + F.col("place") - 1).cast("int")).select(*[c for c in lines.columns if c != "global_index"], "global_index")


def page_medians(lines: DataFrame) -> DataFrame:
    """Median positive font (12 if none) and median gap between lines (8 below two lines)."""
    w = Window.partitionBy(*PAGE).orderBy("line_no")
    gap = F.lead("y0").over(w) - F.col("y1")
    gap = F.when(gap.isNotNull(), F.greatest(F.lit(0.0), gap))  # the last line has none
    g = lines.withColumn("gap", gap).groupBy(*PAGE)
    return g.agg(F.coalesce(F.median(F.when(F.col("font_size") > 0, F.col("font_size"))), F.lit(12.0)).alias("median_font"), F.coalesce(F.median("gap"), F.lit(8.0)).alias("median_gap"))


def with_gaps(lines: DataFrame) -> DataFrame:
    """Gaps to the lines around, 0 at least; the first line's is to the page's top and the last
    one's to its bottom (which may be negative)."""
    w = Window.partitionBy(*PAGE).orderBy("line_no")
    none = F.lit(0.0)
    before = F.coalesce(F.greatest(F.col("y0") - F.lag("y1").over(w), F.when(F.lag("y1").over(w).isNotNull(), none)), F.col("y0"))
    after = F.coalesce(F.greatest(F.lead("y0").over(w) - F.col("y1"), F.when(F.lead("y0").over(w).isNotNull(), none)), F.col("page_height") - F.col("y1"))
    return lines.withColumns({"gap_before": before, "gap_after": after})


def is_centered() -> Column:
    return F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("page_width") / 2) <= 0.14 * F.col("page_width")


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """withColumns behind a generator, so that long expressions are computed once and not
    copied into every expression that uses them."""
    names = [c for c in df.columns if c not in columns]
    one = F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()])))
    return df.select(*names, one.alias("settled")).select(*names, *[F.col(f"settled.{k}").alias(k) for k in columns])


def _near_edge() -> Column:
    return (F.col("y0") < 0.15 * F.col("page_height")) | (F.col("y1") > 0.85 * F.col("page_height"))


def _page_counts(lines: DataFrame, pages: DataFrame | None) -> DataFrame:
    n = F.max("page_num").cast("long") if pages is None else F.count("*")
    return (lines if pages is None else pages).groupBy("book_id").agg(n.alias("pages"))


def _repeated(keyed: DataFrame, pages: DataFrame) -> DataFrame:
    """keyed has norm; the domain test is settled with it."""
    seen = keyed.where((F.col("norm") != "") & (_near_edge() | F.col("domain")))
    n = seen.groupBy("book_id", "norm").agg(F.count_distinct("page_num").alias("n_pages"), F.max("domain").alias("domain"))
    least = F.greatest(F.lit(3), F.ceil(0.05 * F.col("pages")))
    return matched(n, pages, ["book_id"]).where(F.col("domain") | ((F.col("n_pages") >= least) & (F.length("norm") <= 80))).select("book_id", "norm", "n_pages")


def _keyed(lines: DataFrame) -> DataFrame:
    keyed = settled(lines, {"norm": T.counting_key("text", clean=True)})
    return settled(keyed, {"domain": T.matches(F.col("norm"), T.DOMAIN)})


def repeated_edges(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(book_id, norm) of headers, footers and watermarks.

    Counted are lines near a page edge or with a domain, per book on distinct pages; a norm
    repeats from max(3, ceil(5 % of the pages)) pages on, or at once if it has a domain. A
    line table has no row for an empty page, so a book's pages are those of ``pages`` (a row
    each), or without it as many as its largest page number. Line texts are clean.
    """
    return _repeated(_keyed(lines), _page_counts(lines, pages))


def marked_edges(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """All lines with ``removed``: repeated edges, and page numbers at an edge unless they
    number a section (above a heading) or, at the very top in the middle and large, a chapter."""
    flags = settled(_keyed(lines), {
        "number": T.is_page_number("text", clean=True), "numeric": T.is_numeric_only("text", clean=True), "heading": T.is_heading_line("text", clean=True), "body": T.is_body_like("text", clean=True),
    })
    repeats = _repeated(_keyed(lines), _page_counts(lines, pages)).select("book_id", "norm", F.lit(True).alias("repeat"))
    page = Window.partitionBy(*PAGE)
    following = Window.partitionBy(*PAGE).orderBy("line_no")
    lead = lambda c: F.coalesce(F.lead(c).over(following), F.lit(False))
    worded = (F.size(F.split("text", " ")) >= 6) & ~F.col("number")
    m = flags.withColumns({
        "median_font": F.coalesce(F.median(F.when(F.col("font_size") > 0, F.col("font_size"))).over(page), F.lit(12.0)),
        "next_heading": lead("heading"), "next_text": lead("heading") | lead("body") | lead(worded),
    })
    large, h = F.col("font_size") >= 1.1 * F.col("median_font"), F.col("page_height")
    section = (F.col("y0") < 0.25 * h) & F.col("next_heading") & (F.length("text") <= 4) & (is_centered() | large)
    chapter = F.col("numeric") & (F.col("y0") <= 0.12 * h) & is_centered() & large & F.col("next_text")
    out = matched(m, repeats, ["book_id", "norm"], "left")
    gone = F.col("repeat").isNotNull() | (F.col("number") & _near_edge() & ~section & ~chapter)
    return out.withColumn("removed", gone).select(*lines.columns, "removed")


def without_edges(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Lines without repeated edges, nor edge page numbers that number nothing else."""
    return marked_edges(lines, pages).where("NOT removed").drop("removed")


def removed_preview(lines: DataFrame, k: int = 10, pages: DataFrame | None = None) -> DataFrame:
    """The most frequent removed texts of every book, page numbers too; ties by first seen."""
    gone = marked_edges(lines, pages).where("removed")
    n = gone.groupBy("book_id", "text").agg(F.count("*").alias("n"), F.min(F.struct("page_num", "line_no")).alias("first"))
    order = Window.partitionBy("book_id").orderBy(F.col("n").desc(), "first")
    return n.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("book_id", "rank", F.format_string("%s (x%d)", "text", "n").alias("preview"))


def plain_text(lines: DataFrame) -> DataFrame:
    """(book_id, text): lines by line break and pages by a blank line, without page numbers; a
    line after one that ends in "-" is glued to it."""
    kept = lines.where((F.col("text") != "") & ~T.is_page_number("text", clean=True))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    glue = lambda done, x: F.when(done.isNull(), x["text"]).when(done.endswith("-"), F.concat(F.regexp_replace(done, "-$", ""), x["text"])).otherwise(F.concat(done, F.lit("\n"), x["text"]))
    page = kept.groupBy(*PAGE).agg(F.aggregate(parts, F.lit(None).cast("string"), glue).alias("text"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("page_num", "text"))), lambda x: x["text"])
    return page.groupBy("book_id").agg(F.array_join(whole, "\n\n").alias("text"))


def numbered(lines: DataFrame, keys: list[str], paragraph_gap: str = "reference") -> DataFrame:
    """Lines with ``new`` (1 where a paragraph begins) and ``in_page``, its number in the page."""
    page = Window.partitionBy(*keys, "page_num").orderBy("line_no")
    least = F.greatest(F.lit(8.0), 0.012 * F.col("page_height")) if paragraph_gap == "reference" else F.lit(8.0)
    new = F.coalesce((F.col("y0") - F.lag("y1").over(page) > least).cast("int"), F.lit(1))
    return lines.withColumn("new", new).withColumn("in_page", F.sum("new").over(page))


def glued(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The texts of numbered lines by paragraph of a page."""
    parts = F.array_sort(F.collect_list(F.struct("line_no", "text")))

    def glue(done, x):
        hyphen = done.rlike("-$") & x["text"].rlike(r"^\p{Ll}")
        return F.when(done == "", x["text"]).when(hyphen, F.concat(F.regexp_replace(done, "-$", ""), x["text"])).otherwise(F.concat(done, F.lit(" "), x["text"]))

    return lines.groupBy(*keys, "page_num", "in_page").agg(F.aggregate(parts, F.lit(""), glue).alias("text"))


def paragraphs(lines: DataFrame, keys: list[str] | None = None, paragraph_gap: str = "reference") -> DataFrame:
    """Lines -> paragraphs: a new one on a new page or a gap over max(8, 1.2 % of the height);
    a line ending in "-" is glued to a next one that starts in lower case.

    A new page always begins a paragraph, so lines are ordered within pages only and a book's
    pages meet by their numbers of paragraphs. ``paragraph_gap="blank_line"`` takes any gap of
    more than 8, whatever the page's height (in a long text file blank lines part nothing else).
    """
    keys = keys or ["book_id"]
    marked = numbered(lines, keys, paragraph_gap)
    texts = glued(marked, keys)
    before = Window.partitionBy(*keys).orderBy("page_num").rowsBetween(Window.unboundedPreceding, -1)
    counts = marked.groupBy(*keys, "page_num").agg(F.sum("new").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return matched(texts, counts.drop("n"), [*keys, "page_num"]).select(*keys, (F.col("ahead") + F.col("in_page")).alias("paragraph"), "text")
