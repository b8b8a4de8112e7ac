"""From page text and cells to segments: chunking, table rows, furniture, block graphs, positional spans."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamizal.functions import text as T


def chunks(text: Column, size: int = 200, overlap: int = 20, least: int = 20) -> Column:
    """Sliding windows of size words, overlap words shared with the next; windows of at most least characters are dropped."""
    words = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)\\s+", " "), " "), lambda w: w != "")
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, size), " ")), lambda c: F.length(c) > least)


def prose_units(text: Column) -> Column:
    """The text cut before each article heading, if at least two units begin with one; else whole."""
    units = F.split(text, "(?=\\b(?iu:Art[íi]culo)\\s+[0-9]+\\s*[°º]?\\s*[.:–—-]?\\s+\\p{Lu})")
    return F.when(F.size(F.filter(units, lambda u: T.is_article_heading(u))) >= 2, F.filter(units, lambda u: F.trim(u) != "")).otherwise(F.array(text))


def without_bar_lines(text: Column) -> Column:
    """The text without the lines that hold a bar (serialized table rows)."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~F.contains(x, F.lit("|"))), "\n")


def headings(text: Column, prefix: str = "EXAMEN ", most: int = 90) -> Column:
    """Distinct lines that begin with the prefix, up to most characters."""
    lines = F.transform(F.split(text, "\n"), lambda x: T.strip(x))
    return F.array_distinct(F.filter(lines, lambda x: x.startswith(prefix) & (F.length(x) <= most)))


def clauses(text: Column) -> Column:
    """The parts of a text that numbered marks (1. 1.2 a)) begin, with their marks."""
    parts = F.split(text, "(?=(?:^|\\s)(?:[0-9]+(?:\\.[0-9]+)*[.)]|[a-z]\\))\\s+\\p{L})")
    return F.filter(F.transform(parts, lambda p: T.strip(p)), lambda p: p.rlike("^(?:[0-9]+(?:\\.[0-9]+)*[.)]|[a-z]\\))\\s"))


def serialize_row(prefix: Column, headers: Column, cells: Column, separator: str = " | ") -> Column:
    """`prefix: header: cell | header: cell`; a first cell without header is an Item, others are Dato n; empty cells are left out."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(cells) - 1), lambda i: F.struct(F.when(F.coalesce(F.trim(F.get(headers, i)), F.lit("")) != "", F.get(headers, i)).when(i == 0, F.lit("Item")).otherwise(F.concat(F.lit("Dato "), i)).alias("h"), F.get(cells, i).alias("c")))
    kept = F.filter(pairs, lambda p: F.coalesce(F.trim(p["c"]), F.lit("")) != "")
    return F.when(F.size(cells) > 0, F.concat(prefix, F.lit(": "), F.array_join(F.transform(kept, lambda p: F.concat(p["h"], F.lit(": "), p["c"])), separator)))


def table_like_groups(df: DataFrame, key: str, text: str, least: int = 2) -> DataFrame:
    """key, first_line, lines: runs of consecutive lines that split into two or more cells at tabs or double spaces (gaps and islands)."""
    l = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))  # noqa: E741
    cut = l.where((T.strip(F.col("line")) != "") & T.strip(F.col("line")).rlike("\t|\\s{2,}"))
    w = Window.partitionBy(key).orderBy("at")
    return cut.withColumn("island", F.col("at") - F.row_number().over(w)).groupBy(key, "island").agg((F.min("at") + 1).alias("first_line"), F.count("*").alias("lines")).where(F.col("lines") >= least).drop("island")


def furniture(lines: DataFrame, document: str, page: str, line: str, least: int = 3) -> DataFrame:
    """document and signature of the lines that stand, digits apart, on at least so many distinct pages of a document."""
    signature = F.regexp_replace(T.norm(F.col(line)), "[0-9]+", "#")
    s = lines.select(F.col(document), F.col(page), signature.alias("signature")).where("signature <> ''")
    return s.groupBy(document, "signature").agg(F.countDistinct(page).alias("pages")).where(F.col("pages") >= least)


def page_texts(df: DataFrame, source: str = "source", page: str = "page", seq: str = "seq", text: str = "text") -> DataFrame:
    """The texts of each page of a source, joined in order."""
    return df.where(F.col(text).isNotNull()).groupBy(F.lower(F.trim(source)).alias(source), page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, text))), lambda x: x[text]), "\n").alias("text"), F.count("*").alias("segments"))


def parse_blocks(blocks: DataFrame) -> DataFrame:
    """Cells of a recognized page's block graph: page, tbl, row, row_end, col, col_end, text, confidence.

    blocks: page, id, kind (TABLE, CELL, WORD, SELECTION), children array<string>, row, col, row_span,
    col_span, text, confidence, place. Words go to their cell and cells to their table by joins on ids.
    """
    child = blocks.select("page", "id", "kind", F.explode("children").alias("child"))
    tables = child.where("kind = 'TABLE'").select("page", F.col("id").alias("tbl"), F.col("child").alias("cell"))
    words = blocks.where("kind in ('WORD', 'SELECTION')").select("page", F.col("id").alias("child"), "text", "confidence", "place")
    inside = child.where("kind = 'CELL'").join(words, ["page", "child"]).groupBy("page", F.col("id").alias("cell")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " ").alias("text"), F.min("confidence").alias("confidence"))
    cell = blocks.where("kind = 'CELL'").select("page", F.col("id").alias("cell"), "row", "col", (F.col("row") + F.coalesce("row_span", F.lit(1)) - 1).alias("row_end"), (F.col("col") + F.coalesce("col_span", F.lit(1)) - 1).alias("col_end"))
    return tables.join(cell, ["page", "cell"]).join(inside, ["page", "cell"], "left").select("page", "tbl", "row", "row_end", "col", "col_end", F.coalesce("text", F.lit("")).alias("text"), "confidence")


def lines_outside_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Lines (page, x, y) whose centre lies in no table box (page, x0, y0, x1, y1) of the page."""
    inside = (F.col("l.page") == F.col("t.page")) & F.col("l.x").between(F.col("t.x0"), F.col("t.x1")) & F.col("l.y").between(F.col("t.y0"), F.col("t.y1"))
    return lines.alias("l").join(tables.alias("t"), inside, "left_anti")


def raster(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, row and values: the grid's rows, a spanning cell's text in each place it covers."""
    every = cells.select(*keys, "text", F.explode(F.sequence("row", "row_end")).alias("row"), "col", "col_end").select(*keys, "row", "text", F.explode(F.sequence("col", "col_end")).alias("col"))
    width = every.groupBy(*keys).agg(F.max("col").alias("width"))
    row = every.groupBy(*keys, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m")).join(width, list(keys))
    return row.select(*keys, "row", F.transform(F.sequence(F.lit(1), F.col("width")), lambda i: F.coalesce(F.element_at("m", i), F.lit(""))).alias("row_values"))


def wrapped_rows(rows: DataFrame, by: tuple[str, ...], order: str, wrapped: Column, text: str, separator: str = " ") -> DataFrame:
    """Rows joined with the wrapped rows that follow them: each unwrapped row opens an island, in order."""
    w = Window.partitionBy(*by).orderBy(order)
    island = F.sum((~wrapped).cast("int")).over(w)
    return rows.withColumn("island", island).groupBy(*by, "island").agg(F.min(order).alias(order), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), separator).alias(text)).drop("island")


def spans_equal(rows: DataFrame, by: tuple[str, ...], order: str, text: str, target: Column, most: int = 3) -> DataFrame:
    """first and last place of up to most consecutive rows whose joined normal form equals target."""
    w = Window.partitionBy(*by).orderBy(order)
    ahead = rows.select(*by, order, target.alias("target"), *(F.lead(text, i).over(w).alias(f"t{i}") for i in range(most)), *(F.lead(order, i).over(w).alias(f"o{i}") for i in range(most)))
    tries = F.array(*(F.struct(F.concat_ws(" ", *(F.col(f"t{j}") for j in range(i + 1))).alias("joined"), F.col(f"o{i}").alias("last")) for i in range(most)))
    return ahead.select(*by, F.col(order).alias("first"), "target", F.explode(tries).alias("x")).where(F.col("x.last").isNotNull() & (T.norm(F.col("x.joined")) == T.norm(F.col("target")))).select(*by, "first", F.col("x.last").alias("last"))


def next_boundary(rows: DataFrame, by: tuple[str, ...], order: str, boundary: Column) -> DataFrame:
    """rows with ends: the place of the next boundary row after each, null if there is none."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("ends", F.min(F.when(boundary, F.col(order))).over(w))


def cluster_lines(df: DataFrame, keys: tuple[str, ...], y: str, height: str, tolerance: float = 0.4) -> DataFrame:
    """df with line_no: detections of a page in order of y, a new line where the gap to the one before exceeds tolerance heights."""
    w = Window.partitionBy(*keys).orderBy(y)
    gap = F.col(y) - F.lag(y).over(w)
    return df.withColumn("opens", (F.coalesce(gap, F.lit(1e9)) > tolerance * F.col(height)).cast("int")).withColumn("line_no", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def cluster_boundaries(df: DataFrame, keys: tuple[str, ...], value: str, tolerance: float) -> DataFrame:
    """keys, centre and n: sorted values joined to the running mean of their cluster while within tolerance (sequential, so by Arrow groups; a group is a page's rulings)."""
    import pandas as pd

    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[list[float]] = []
        for v in sorted(pdf[value].dropna()):
            if found and v - sum(found[-1]) / len(found[-1]) <= tolerance:
                found[-1].append(v)
            else:
                found.append([v])
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "centre": sum(c) / len(c), "n": len(c)} for c in found], columns=[*keys, "centre", "n"])

    return df.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", centre double, n bigint")


def header_row(rows: DataFrame, keys: tuple[str, ...], row: str, values: str, within: int = 3) -> DataFrame:
    """keys and row of each grid's header: the last of its first rows with three values or more, mostly letters and short."""
    v = F.filter(F.col(values), lambda x: F.trim(x) != "")
    joined = F.array_join(v, "")
    letters = F.length(F.regexp_replace(joined, "[^\\p{L}]", "")) >= 0.65 * F.length(F.regexp_replace(joined, "\\s", ""))
    short = F.size(F.filter(v, lambda x: F.length(x) <= 40)) >= 0.8 * F.size(v)
    return rows.where((F.col(row) <= within) & (F.size(v) >= 3) & letters & short).groupBy(*keys).agg(F.max(row).alias(row))


def split_pages(text: Column) -> Column:
    """Pages of a text layer cut at form feeds; a blank last page is dropped."""
    pages = F.split(text, "\f", -1)
    return F.when(T.strip(F.element_at(pages, -1)) == "", F.slice(pages, 1, F.size(pages) - 1)).otherwise(pages)


def with_extraction_method(pages: DataFrame, text: str = "text", ink: str = "ink", blank: float = 0.0001) -> DataFrame:
    """pages with method, how a page is to be read: its text layer, not at all if it is blank, else by recognition."""
    from tamizal.functions.predicates import with_text_quality

    q = with_text_quality(pages, text)
    return q.withColumn("method", F.when(F.col("quality.status") == "native_text", "native_text").when(F.col(ink) < blank, "blank").otherwise("ocr")).drop("quality")


def in_batches(df: DataFrame, provider, schema: str) -> DataFrame:
    """df through a provider (a model, a recognizer): a function of pandas batches, built once in each worker."""

    def run(batches: Iterator) -> Iterator:
        call = provider()
        for pdf in batches:
            yield call(pdf)

    return df.mapInPandas(run, schema)


def table_like_rows(df: DataFrame, key: str, text: str, least: int = 2) -> DataFrame:
    """key, line_no, first_line and cells of the lines in table_like_groups: what stands between tabs or double spaces."""
    l = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))  # noqa: E741
    cut = l.withColumn("line", T.strip(F.col("line"))).where((F.col("line") != "") & F.col("line").rlike("\t|\\s{2,}"))
    w = Window.partitionBy(key).orderBy("at")
    island = cut.withColumn("island", F.col("at") - F.row_number().over(w))
    group = Window.partitionBy(key, "island")
    sized = island.withColumns({"lines": F.count("*").over(group), "first_line": F.min("at").over(group) + 1}).where(F.col("lines") >= least)
    return sized.select(key, (F.col("at") + 1).alias("line_no"), "first_line", F.split("line", "\\t|\\s{2,}").alias("cells"))


def ruled_tables(rows: DataFrame, keys: tuple[str, ...], values: str, least_rows: int = 2, least_columns: int = 2) -> DataFrame:
    """keys, rows and columns of the tables with enough rows that hold anything and enough columns; white space in cells is collapsed."""
    clean = F.transform(values, lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), "(?U)\\s+", " ")))
    r = rows.select(*keys, clean.alias("v")).where(F.exists("v", lambda x: x != ""))
    return r.groupBy(*keys).agg(F.count("*").alias("rows"), F.max(F.size("v")).alias("columns")).where((F.col("rows") >= least_rows) & (F.col("columns") >= least_columns))


def parent_headers(headers: DataFrame, parents: DataFrame) -> DataFrame:
    """tbl, col and label: headers (tbl, col, x0, x1, text) under a parent (tbl, x0, x1, text) whose middle lies within it become `parent / header`.

    Where a parent stands over several `Fase` headers without a numeral of their own, they are numbered from the left.
    """
    h, p = headers.alias("h"), parents.select("tbl", F.col("x0").alias("p0"), F.col("x1").alias("p1"), F.col("text").alias("parent"))
    middle = (F.col("x0") + F.col("x1")) / 2
    both = h.join(p, "tbl", "left").withColumn("inside", (middle >= F.col("p0")) & (middle < F.col("p1")))
    one = both.groupBy("tbl", "col", "x0", "text").agg(F.min(F.when(F.col("inside"), F.col("parent"))).alias("parent"))
    phase = F.lower("text").startswith("fase")
    bare = phase & ~F.trim(F.regexp_replace("text", "(?i)^fase\\s*", "")).rlike("(?i)^(?:I{1,3}|IV|V|[1-9])$")
    group = Window.partitionBy("tbl", "parent")
    numbered = one.withColumns({"phases": F.sum(phase.cast("int")).over(group), "at": F.sum(phase.cast("int")).over(group.orderBy("x0").rowsBetween(Window.unboundedPreceding, 0))})
    numeral = F.element_at(F.array(*(F.lit(x) for x in ("I", "II", "III", "IV"))), F.least(F.col("at"), F.lit(4)).cast("int"))
    text = F.when(bare & F.col("parent").isNotNull() & (F.col("phases") > 1), F.concat(F.lit("Fase "), numeral)).otherwise(F.col("text"))
    return numbered.select("tbl", "col", F.concat_ws(" / ", "parent", text).alias("label"))


def table_passages(rows: DataFrame, keys: tuple[str, ...], category: Column, exam: Column, headers: str, cells: str, least: int = 20) -> DataFrame:
    """keys and passage: `CATEGORY | exam | label: value; …` of each row, if it is long enough; a first cell without label is an Item, others are Dato n."""
    body = F.regexp_replace(serialize_row(F.lit(""), F.col(headers), F.col(cells), "; "), "^: ", "")
    return rows.where(F.size(cells) > 0).select(*keys, F.concat_ws(" | ", category, exam, body).alias("passage")).where(F.length("passage") >= least)


def clause_depths(text: Column) -> Column:
    """The clauses of a text with their depth: the dots inside a numbered mark, one more for a letter's."""
    return F.transform(clauses(text), lambda c: F.struct(F.when(c.rlike("^[a-z]\\)"), 1).otherwise(F.length(F.regexp_replace(F.regexp_extract(c, "^([0-9.]+)", 1), "[^.]|\\.$", ""))).alias("depth"), c.alias("clause")))


def line_candidates(lines: DataFrame, by: tuple[str, ...], order: str, line: str, heading: Column, item: Column) -> DataFrame:
    """by, order, the last heading before each item line (carried forward within by), and the line; items before any heading are left out."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    carried = lines.withColumn("heading", F.last(F.when(heading, F.col(line)), ignorenulls=True).over(w))
    return carried.where(item & ~heading & F.col("heading").isNotNull()).select(*by, order, "heading", F.col(line).alias("item"))


def article_candidates(lines: DataFrame, keys: tuple[str, ...], line: str) -> DataFrame:
    """keys, article, query and answer: a question for each line that opens with an article's heading and says something acceptable after it."""
    number = F.regexp_extract(line, T.ARTICLE_START, 1)
    # spread from an array of one, so that the long expression is computed once and not put into those that read it
    body = F.explode(F.array(T.article_body(F.regexp_replace(F.col(line), "\\r$", ""))))
    found = lines.where(T.is_article_heading(F.col(line))).select(*keys, number.cast("int").alias("article"), body.alias("answer"))
    return found.where(T.acceptable(F.col("answer"))).select(*keys, "article", F.concat(F.lit("¿Qué establece el artículo "), F.col("article").cast("string"), F.lit("?")).alias("query"), "answer")


def in_reading_order(tables: DataFrame, prose: DataFrame) -> DataFrame:
    """page, place, kind and text of a page's tables and lines (each page, y, text), put together from top to bottom; a table stands before a line of the same height."""
    both = tables.select("page", "y", F.lit("table").alias("kind"), "text").unionByName(prose.select("page", "y", F.lit("line").alias("kind"), "text"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy("y", F.desc("kind"), "text"))).select("page", "place", "kind", "text")


def page_segments(tables: DataFrame, prose: DataFrame, keys: tuple[str, ...], size: int = 200, overlap: int = 20) -> DataFrame:
    """keys, kind, table_no, row_no, chunk_no and text: the rows of tables (keys, table_no, row_no, headers, cells) serialized, and the prose (keys, text) in chunks."""
    row = serialize_row(F.concat(F.lit("Tabla "), "table_no", F.lit(" — fila "), "row_no"), F.col("headers"), F.col("cells"))
    none = F.lit(None).cast("int")
    a = tables.where(F.size("cells") > 0).select(*keys, F.lit("table_row").alias("kind"), "table_no", "row_no", none.alias("chunk_no"), row.alias("text"))
    b = prose.select(*keys, F.posexplode(chunks(F.col("text"), size, overlap)).alias("chunk_no", "text")).select(*keys, F.lit("prose_chunk").alias("kind"), none.alias("table_no"), none.alias("row_no"), "chunk_no", "text")
    return a.unionByName(b)
