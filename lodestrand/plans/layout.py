"""Layout queries over the lines of documents as blocks: margins, figures, equations, tables, nested parser content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.operators import found_tables
from lodestrand.operators import layout as lay
from lodestrand.operators import regions as rg
from lodestrand.plans.registry import Tables, query
from lodestrand.plans.tables import _B, _blocks
from lodestrand.plans.texts import SQZ
from lodestrand.runtime import materialize

_LINE = SQZ.format(c="text")
_BODY = rf"regexp_replace({_LINE}, '^(?:[0-9]+(?:\.[0-9]+)*\.?|[IVXLCDM]+\.)\s+(\S)', '\1')"
_VERBS = "[" + ", ".join(f"'{v}'" for v in lay.SENTENCE_VERBS) + "]"


@query(
    rf"""WITH {_B}, s AS (SELECT uid, {_LINE} AS line, {_BODY} AS body FROM b), w AS (SELECT *, list_transform(regexp_extract_all(body, '[\p{{L}}\p{{N}}_]+'), lambda x: lower(x)) AS words FROM s)
    SELECT uid, line <> '' AND ((regexp_matches(body, '[.!?。！？;；:]\s*$') AND (len(words) >= 5 OR length(body) >= 28 OR list_has_any(words, {_VERBS}))) OR (len(words) >= 12 AND regexp_matches(body, '[,;，；]'))) AS sentence FROM w"""
)
def sentence_lines(t: Tables) -> DataFrame:
    return _blocks(t).select("uid", lay.sentence_like(F.col("text")).alias("sentence"))


_MARGIN = r"CASE WHEN regexp_matches(text, '^\s*[0-9]+\s*$') THEN '<page-number>' ELSE lower(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'))) END"


@query(
    f"""WITH {_B}, h AS (SELECT *, max(y1) OVER (PARTITION BY doc_id, page) AS height, {_MARGIN} AS margin FROM b),
    k AS (SELECT *, CASE WHEN y0 <= 0.1 * height THEN 'header' WHEN y1 >= 0.9 * height THEN 'footer' END AS kind FROM h WHERE height > 0 AND margin <> ''),
    p AS (SELECT doc_id, greatest(1, ceil(0.6 * count(DISTINCT page))) AS least_ FROM b GROUP BY 1), s AS (SELECT doc_id, kind, margin, count(DISTINCT page) AS pages FROM k WHERE kind IS NOT NULL GROUP BY ALL)
    SELECT k.doc_id, k.page, k.uid, k.kind FROM k JOIN s USING (doc_id, kind, margin) JOIN p USING (doc_id) WHERE pages >= least_"""
)
def inferred_margins(t: Tables) -> DataFrame:
    return lay.inferred_margins(_blocks(t))


@query()
def merged_expressions(t: Tables) -> DataFrame:
    """Lines drawn nearer together, so that some stand one below the other."""
    b = _blocks(t).withColumn("y1", F.col("y0") + F.when(F.col("ord") % 3 == 0, 85.0).otherwise(40.0)).withColumn("x0", F.col("ord") % 5 * 4.0).withColumn("x1", F.col("x0") + 100)
    return lay.merged_expressions(b.select("doc_id", "page", "y0", "x0", "x1", "y1", "text"))


@query()
def merged_figures(t: Tables) -> DataFrame:
    b = _blocks(t).withColumn("y1", F.col("y0") + F.when(F.col("ord") % 4 == 1, 130.0).otherwise(40.0)).withColumn("kind", F.when(F.col("ord") % 2 == 0, "raster").otherwise("vector")).withColumn("side", F.lit(720.0))
    return lay.merged_figures(b.where("x1 > x0").select("doc_id", "page", "y0", "x0", "kind", "x1", "y1", "side"))


@query(
    f"""WITH {_B}, r AS (SELECT *, ord % 5 AS xref, 720.0 AS height FROM b WHERE x1 - x0 > 2 AND y1 - y0 > 2 AND (x1 - x0) * (y1 - y0) / (width * 720.0) BETWEEN 0.01 AND 0.9),
    m AS (SELECT *, round(x0, 0) AS p0, round(y0, 0) AS p1, round(x1, 0) AS p2, round(y1, 0) AS p3 FROM r), s AS (SELECT doc_id, xref, p0, p1, p2, p3 FROM m GROUP BY ALL HAVING count(DISTINCT page) >= 3),
    o AS (SELECT * FROM m ANTI JOIN s USING (doc_id, xref, p0, p1, p2, p3)) SELECT doc_id, page, uid, xref FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, xref ORDER BY y0, x0, uid) AS n FROM o) WHERE n = 1"""
)
def figure_candidates(t: Tables) -> DataFrame:
    return lay.figure_candidates(_blocks(t).withColumn("xref", F.col("ord") % 5).withColumn("height", F.lit(720.0)))


@query()
def equation_labels(t: Tables) -> DataFrame:
    """Every second line in the left column as an expression, the lines of the right one as labels on its line."""
    b = _blocks(t).where("x1 > x0").withColumn("y0", F.floor(F.col("ord") % 8 / 2) * 90.0).withColumn("y1", F.col("y0") + 40)
    left = b.where("ord % 3 <> 1").withColumn("x1", F.least("x1", F.lit(300.0)))
    return lay.equation_labels(left.select("doc_id", "page", "uid", "x0", "y0", "x1", "y1"), b.where("ord % 3 = 1").select("doc_id", "page", "uid", "x0", "y0", "x1", "y1"))


@query(
    f"""WITH {_B}, e AS (SELECT *, CASE WHEN ord % 4 = 0 THEN 's' || (ord // 4 % 2) END AS section FROM b WHERE ord % 4 = 0), x AS (SELECT *, CASE WHEN ord % 3 = 0 THEN 's' || (ord % 2) END AS section FROM b),
    j AS (SELECT e.doc_id, e.page, e.uid, x.uid AS t_uid, x.text, CASE WHEN x.y1 <= e.y0 THEN e.y0 - x.y1 WHEN x.y0 >= e.y1 THEN x.y0 - e.y1 END AS apart FROM e JOIN x ON e.doc_id = x.doc_id AND e.page = x.page AND e.uid <> x.uid AND (e.section IS NULL OR x.section IS NULL OR e.section = x.section) WHERE trim(x.text) <> ''),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, uid ORDER BY apart, t_uid) AS n FROM j WHERE apart <= 140) SELECT doc_id, page, uid, string_agg(text, ' ' ORDER BY n) AS context FROM r WHERE n <= 2 GROUP BY ALL"""
)
def equation_context(t: Tables) -> DataFrame:
    b = _blocks(t)
    e = b.where("ord % 4 = 0").withColumn("section", F.concat(F.lit("s"), (F.floor(F.col("ord") / 4) % 2).cast("string"))).select("doc_id", "page", "uid", "y0", "y1", "section")
    x = b.withColumn("section", F.when(F.col("ord") % 3 == 0, F.concat(F.lit("s"), (F.col("ord") % 2).cast("string"))))
    return lay.equation_context(e, x)


_G = f"""{_B}, tb AS (SELECT DISTINCT doc_id, page, 0 AS table_id, 0.0::DOUBLE AS tx0, 0.0::DOUBLE AS ty0, 600.0::DOUBLE AS tx1, 720.0::DOUBLE AS ty1 FROM b),
ln AS (SELECT doc_id, page, CASE WHEN ord % 2 = 0 THEN x0 ELSE 0.0 END AS x0, CASE WHEN ord % 2 = 0 THEN 0.0 ELSE y0 END AS y0, CASE WHEN ord % 2 = 0 THEN x0 + 1 ELSE x1 END AS x1, CASE WHEN ord % 2 = 0 THEN 600.0 ELSE y0 + 1 END AS y1 FROM b),
gb AS (SELECT tb.doc_id, tb.page, table_id, list_sort(list_distinct(list(round(x0, 3)) FILTER (up) || [0.0, 600.0])) AS xs, list_sort(list_distinct(list(round(y0, 3)) FILTER (lv) || [0.0, 720.0])) AS ys FROM tb JOIN
  (SELECT *, x1 - x0 <= 1.5 AND y1 - y0 >= 360 AND x1 <= 601 AND x0 >= -1 AND y0 >= -1 AND y1 <= 721 AS up, NOT (x1 - x0 <= 1.5 AND y1 - y0 >= 360) AND y1 - y0 <= 1.5 AND x1 - x0 >= 300 AND x1 <= 601 AND x0 >= -1 AND y0 >= -1 AND y1 <= 721 AS lv FROM ln) l ON l.doc_id = tb.doc_id AND l.page = tb.page GROUP BY ALL)"""
_G = _G.replace("list(round(x0, 3)) FILTER (up)", "coalesce(list(round(x0, 3)) FILTER (up), [])").replace("list(round(y0, 3)) FILTER (lv)", "coalesce(list(round(y0, 3)) FILTER (lv), [])")


def _grid(t: Tables) -> DataFrame:
    """Even lines drawn upright, odd ones level, in a table as large as the page."""
    b = _blocks(t)
    even = F.col("ord") % 2 == 0
    lines = b.select("doc_id", "page", F.when(even, F.col("x0")).otherwise(0.0).alias("x0"), F.when(even, 0.0).otherwise(F.col("y0")).alias("y0"), F.when(even, F.col("x0") + 1).otherwise(F.col("x1")).alias("x1"), F.when(even, 600.0).otherwise(F.col("y0") + 1).alias("y1"))
    tables = b.select("doc_id", "page").distinct().select("*", F.lit(0).alias("table_id"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(600.0).alias("x1"), F.lit(720.0).alias("y1"))
    return lay.grid_bounds(lines, tables)


@query(f"WITH {_G} SELECT doc_id, page, xs, ys FROM gb")
def grid_bounds(t: Tables) -> DataFrame:
    return _grid(t).drop("table_id")


@query(f"WITH {_G}, f AS (SELECT doc_id, page, count(DISTINCT (ord % 8, ord % 3)) AS filled FROM b WHERE trim(coalesce(text, '')) <> '' GROUP BY ALL) SELECT gb.doc_id, gb.page, len(xs) - 1 >= 2 AND len(ys) - 1 >= 2 AND coalesce(filled, 0) = (len(xs) - 1) * (len(ys) - 1) AS reliable FROM gb LEFT JOIN f ON f.doc_id = gb.doc_id AND f.page = gb.page")
def reliable_grids(t: Tables) -> DataFrame:
    cells = _blocks(t).select("doc_id", "page", F.lit(0).alias("table_id"), (F.col("ord") % 8).alias("row"), (F.col("ord") % 3).alias("col"), "text")
    return lay.reliable_grid(cells, _grid(t)).drop("table_id")


@query()
def captioned_tables(t: Tables) -> DataFrame:
    """The words of short runs of lines set in rows of three under the first line of each page."""
    words = _blocks(t).where("ord % 8 < 4").select("doc_id", "page", "ord", F.posexplode(F.slice(F.split("text", " "), 1, 3)).alias("i", "text"))
    b = words.select("doc_id", "page", F.concat_ws(":", "doc_id", "ord", "i").alias("uid"), "text", (F.col("i") * 150.0).alias("x0"), (F.col("ord") % 8 * 40.0).alias("y0"), (F.col("i") * 150.0 + 100).alias("x1"), F.lit(600.0).alias("width"))
    c = _blocks(t).where("ord % 8 = 0").select("doc_id", "page", "uid", F.lit(-5.0).alias("y1"))
    return lay.captioned_tables(b, c)


@query(f"WITH {_B}, d AS (SELECT doc_id, 0 AS page, doc_id || ':p' || page AS uid, page AS ord, string_agg(text, chr(10) ORDER BY ord) AS text FROM b GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS source_index, string_split(text, chr(10)) AS p FROM d), e AS (SELECT doc_id, uid, source_index, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS line_no FROM s) SELECT doc_id, uid, source_index, line_no, text FROM e WHERE trim(text) <> ''")
def text_rows(t: Tables) -> DataFrame:
    """Pages of eight lines as blocks of one page."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    d = _blocks(t).groupBy("doc_id", F.col("page").alias("ord")).agg(F.array_join(lines, "\n").alias("text"))
    return lay.text_rows(d.select("doc_id", F.lit(0).alias("page"), F.concat("doc_id", F.lit(":p"), "ord").alias("uid"), "ord", "text")).select("doc_id", "uid", "source_index", "line_no", "text")


@query(f"WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: substring({SQZ.format(c='x')}, 1, 30)), lambda x: x <> '') AS l FROM documents), u AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM s), f AS (SELECT doc_id, x, min(i) AS i FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f) SELECT doc_id, string_agg(x, '|' ORDER BY n) FILTER (n <= 20) AS said FROM r GROUP BY doc_id")
def figure_descriptions(t: Tables) -> DataFrame:
    """The lines of each document as descriptions of a figure."""
    d = t.documents.select("doc_id", lay.described(F.split(F.coalesce("text", F.lit("")), "\n"), 20, 30).alias("l"))
    return d.where("size(l) > 0").select("doc_id", F.array_join("l", "|").alias("said"))


@query("SELECT uid, CASE WHEN trim(caption) = '' THEN 'partial' ELSE 'success' END AS status, list_filter([CASE WHEN trim(caption) = '' THEN 'missing_caption' END, CASE WHEN image IS NULL THEN 'missing_image' END, CASE WHEN w < 20 OR h < 20 THEN 'small_figure' END, CASE WHEN share > 0.6 THEN 'text_dominated' END], lambda x: x IS NOT NULL) AS codes FROM (SELECT doc_id AS uid, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE coalesce(source, '') END AS caption, CASE WHEN lang = 'en' THEN lang END AS image, n_chars % 60 AS w, 40 AS h, (n_chars % 100) / 100.0 AS share FROM documents)")
def figure_warnings(t: Tables) -> DataFrame:
    f = t.documents.select(F.col("doc_id").alias("uid"), F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.coalesce("source", F.lit(""))).alias("caption"), F.when(F.col("lang") == "en", F.col("lang")).alias("image_path"), (F.col("n_chars") % 60).alias("width"), F.lit(40).alias("height"), ((F.col("n_chars") % 100) / 100.0).alias("text_share"))
    return lay.figure_warnings(f)


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN 'x^' || event_id WHEN 2 THEN 'so $a_' || event_id || '$ holds' WHEN 3 THEN event_type || chr(10) || 'last' ELSE 'plain' END AS content FROM events""")
def flat_content(t: Tables) -> DataFrame:
    """Items as text, formula, inline parts, list and plain content."""
    raw = F.expr(
        """CASE event_id % 5 WHEN 0 THEN concat('{"text": " ', event_type, ' "}') WHEN 1 THEN concat('{"latex": "x^', event_id, '"}')
        WHEN 2 THEN concat('{"content": [{"type": "text", "content": "so"}, {"type": "inline_equation", "content": "a_', event_id, '"}, {"type": "text", "content": "holds"}]}')
        WHEN 3 THEN concat('{"list_items": ["', event_type, '", "last"]}') ELSE '{"content": "plain"}' END"""
    )
    return t.events.select("event_id", lay.flat_content(raw).alias("content"))


@query("SELECT d.doc_id AS uid, l.doc_id IS NULL AS added FROM documents d LEFT JOIN labels l USING (doc_id) WHERE trim(coalesce(text, '')) <> ''")
def enriched_chunks(t: Tables) -> DataFrame:
    """Texts as described figures, labels as the chunks that exist."""
    figures = t.documents.select(F.col("doc_id").alias("uid"), F.coalesce("text", F.lit("")).alias("content"))
    update, add = lay.enriched_chunks(figures, t.labels.select(F.col("doc_id").alias("uid"), F.col("doc_id").alias("chunk_id")))
    return update.select(F.col("chunk_id").alias("uid"), F.lit(False).alias("added")).unionByName(add.select("uid", F.lit(True).alias("added")))


_SQZ = SQZ.format(c="text")
_PARSED = f"""{_B}, bl AS (SELECT *, ord - CASE WHEN ord % 11 = 5 THEN 1 ELSE 0 END AS source_index, CASE WHEN ord % 6 = 0 THEN ' ' ELSE text END AS body FROM b),
pg AS (SELECT DISTINCT doc_id, page, CASE WHEN page % 2 = 0 THEN 600.0 ELSE 500.0 END AS width, 720.0 AS height FROM b WHERE page % 5 < 4 AND doc_id % 17 > 0),
rep AS (SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN 2 ELSE 1 END AS pages, length(trim(coalesce(text, ''))) AS chars FROM documents d),
dd AS (SELECT rep.*, coalesce(there, 0) AS there, coalesce(filled, 0) AS filled FROM rep LEFT JOIN (SELECT doc_id, count(DISTINCT page) AS there FROM pg GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, count(DISTINCT page) AS filled FROM bl WHERE ord % 8 < 3 AND trim(body) <> '' GROUP BY 1) USING (doc_id)),
ck AS (SELECT doc_id, 'k' || (ord // 2) AS uid, text, CASE WHEN ord % 4 = 0 THEN ['s1', 's2'] ELSE ['s1'] END AS sections FROM b WHERE ord % 8 < 5),
tl AS (SELECT DISTINCT doc_id, uid, sha1(lower({_SQZ})) AS digest FROM ck WHERE {_SQZ} <> ''), fi AS (SELECT doc_id, digest, min(uid) AS f FROM tl GROUP BY ALL HAVING count(*) > 1),
el AS (SELECT doc_id, page, uid, CASE ord % 3 WHEN 0 THEN 'figure' WHEN 1 THEN 'table' ELSE 'equation' END AS type, CASE WHEN length(text) < 40 THEN 'partial' ELSE 'success' END AS status, CASE WHEN ord % 2 = 0 THEN text ELSE ' ' END AS caption FROM b WHERE ord % 7 = 2)"""


@query(
    f"""WITH {_PARSED}, w AS (SELECT doc_id, 'page_count_mismatch' AS code, NULL::INT AS page, NULL AS uid FROM dd WHERE pages > 0 AND pages <> there UNION ALL SELECT doc_id, 'no_pages', NULL, NULL FROM dd WHERE there = 0
    UNION ALL SELECT doc_id, 'low_text_coverage', NULL, NULL FROM dd WHERE there > 0 AND filled < 0.5 * there UNION ALL SELECT doc_id, 'no_usable_text', NULL, NULL FROM dd WHERE chars = 0
    UNION ALL SELECT bl.doc_id, 'bbox_out_of_bounds', bl.page, uid FROM bl JOIN pg ON pg.doc_id = bl.doc_id AND pg.page = bl.page WHERE ord % 8 < 3 AND (x0 < 0 OR y0 < 0 OR x1 > pg.width OR y1 > pg.height)
    UNION ALL SELECT DISTINCT doc_id, 'suspicious_characters', NULL::INT, NULL FROM bl WHERE ord % 8 < 3 AND regexp_matches(body, '(?:�|Ã.|Â.){{2,}}')
    UNION ALL SELECT DISTINCT doc_id, 'duplicate_source_index', page, NULL FROM (SELECT doc_id, page FROM bl WHERE ord % 8 < 3 GROUP BY doc_id, page, source_index HAVING count(*) > 1)
    UNION ALL SELECT doc_id, 'duplicate_chunk', NULL, uid FROM ck GROUP BY doc_id, uid HAVING count(*) > 1 UNION ALL SELECT tl.doc_id, 'duplicate_chunk_content', NULL, uid FROM tl JOIN fi ON fi.doc_id = tl.doc_id AND fi.digest = tl.digest WHERE uid <> f
    UNION ALL SELECT doc_id, 'cross_section_chunk', NULL, uid FROM ck WHERE len(list_distinct(sections)) > 1 UNION ALL SELECT doc_id, 'partial_element', page, uid FROM el WHERE status <> 'success'
    UNION ALL SELECT doc_id, 'missing_caption', page, uid FROM el WHERE type IN ('figure', 'table') AND trim(caption) = '' UNION ALL SELECT doc_id, 'unresolved_reference', page, uid FROM b WHERE ord % 13 = 4)
    SELECT DISTINCT * FROM w"""
)
def parse_warnings(t: Tables) -> DataFrame:
    """Lines as blocks, chunks, elements and references, some of them spoilt by their place."""
    from lodestrand.operators import quality

    b = _blocks(t)
    o = F.col("ord")
    blocks = b.where("ord % 8 < 3").select("doc_id", "page", "uid", (o - F.when(o % 11 == 5, 1).otherwise(0)).alias("source_index"), "x0", "y0", "x1", "y1", F.when(o % 6 == 0, " ").otherwise(F.col("text")).alias("text"))
    pages = b.where("page % 5 < 4 AND doc_id % 17 > 0").select("doc_id", "page", F.when(F.col("page") % 2 == 0, 600.0).otherwise(500.0).alias("width"), F.lit(720.0).alias("height")).distinct()
    reported = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1).alias("pages"), F.length(F.trim(F.coalesce("text", F.lit("")))).alias("chars"))
    one, two = F.array(F.lit("s1")), F.array(F.lit("s1"), F.lit("s2"))
    chunks = b.where("ord % 8 < 5").select("doc_id", F.concat(F.lit("k"), F.floor(o / 2).cast("string")).alias("uid"), "text", F.when(o % 4 == 0, two).otherwise(one).alias("sections"))
    kind = F.when(o % 3 == 0, "figure").when(o % 3 == 1, "table").otherwise("equation")
    elements = b.where("ord % 7 = 2").select("doc_id", "page", "uid", kind.alias("type"), F.when(F.length("text") < 40, "partial").otherwise("success").alias("status"), F.when(o % 2 == 0, F.col("text")).otherwise(" ").alias("caption"))
    references = b.where("ord % 13 = 4").select("doc_id", "page", "uid", F.lit("unresolved").alias("status"))
    return quality.parse_warnings(reported, pages, blocks, chunks, elements, references)


@query(f"WITH {_B} SELECT doc_id, 'missing_element_image' AS code, page, uid FROM b WHERE ord % 4 = 1 AND ord % 3 <> 0")
def missing_images(t: Tables) -> DataFrame:
    """Every fourth line as a figure with an image, of which two in three are not there any more."""
    from lodestrand.operators import quality

    b, none = _blocks(t), t.documents.where("false")
    e = b.where("ord % 4 = 1").select("doc_id", "page", "uid", F.lit("figure").alias("type"), F.lit("success").alias("status"), F.lit("Figure").alias("caption"), F.concat("uid", F.lit(".png")).alias("image_path"))
    there = b.where("ord % 3 = 0").select("doc_id", F.concat("uid", F.lit(".png")).alias("path"))
    nothing = lambda *columns: none.select("doc_id", *(F.lit(None).cast(kind).alias(n) for n, kind in columns))
    boxes = [(s, "double") for s in ("x0", "y0", "x1", "y1")]
    return quality.parse_warnings(
        nothing(("pages", "int"), ("chars", "int")), nothing(("page", "int"), ("width", "double"), ("height", "double")), nothing(("page", "int"), ("uid", "string"), ("source_index", "int"), *boxes, ("text", "string")),
        nothing(("uid", "string"), ("text", "string"), ("sections", "array<string>")), e, nothing(("page", "int"), ("uid", "string"), ("status", "string")), there,
    )


@query(
    f"""WITH {_B}, f AS (SELECT doc_id, uid, CASE WHEN ord % 5 <> 3 THEN uid || '.png' END AS path, CASE WHEN ord % 7 = 2 THEN ' ' ELSE text END AS caption FROM b WHERE ord % 4 = 1), s AS (SELECT *, trim(regexp_replace(caption, '[ \t\n\r\f\x0B\x1C-\x1F\x85\xA0]+', ' ', 'g')) AS line FROM f)
    SELECT uid, CASE WHEN path IS NOT NULL AND line <> '' THEN rtrim(substring('Figure: ' || line, 1, 200)) END AS text, CASE WHEN path IS NULL THEN 'no_image' WHEN line = '' THEN 'ValueError' END AS error, CASE WHEN path IS NULL OR line = '' THEN 'pending' ELSE 'described' END AS state FROM s"""
)
def described_figures(t: Tables) -> DataFrame:
    """Every fourth line as a figure with its caption, some without an image and some of which nothing is known: those stay pending."""
    from lodestrand.functions import seams

    o = F.col("ord")
    f = _blocks(t).where("ord % 4 = 1").select("uid", F.when(o % 5 != 3, F.concat("uid", F.lit(".png"))).alias("path"), F.when(o % 7 == 2, " ").otherwise(F.col("text")).alias("caption"))
    d = f.select("uid", seams.describer()("path", "caption").alias("d"))
    return d.select("uid", F.col("d.text").alias("text"), F.col("d.error").alias("error"), F.when(F.col("d.error").isNull(), "described").otherwise("pending").alias("state"))


_KINDED = """CASE ord % 12 WHEN 0 THEN (ord % 3 + 1) || '.' || (ord % 2 + 1) || ' ' || substring(text, 1, 20) WHEN 1 THEN 'Figure ' || ord || ': ' || text WHEN 2 THEN 'Table IV ' || text WHEN 3 THEN 'Summary:' WHEN 4 THEN '(2) ' || text
WHEN 5 THEN '- ' || substring(text, 1, 12) WHEN 6 THEN 'y = x (' || ord || ')' WHEN 7 THEN '[3] ' || substring(text, 1, 12) WHEN 8 THEN 'Related Work' WHEN 9 THEN 'a | b | c' ELSE text END"""
_KT = SQZ.format(c="line")
_KBODY = rf"regexp_replace({_KT}, '^(?:[0-9]+(?:\.[0-9]+)*\.?|[IVXLCDM]+\.)\s+(\S)', '\1')"
_KL = r"regexp_replace(lower(t), '[ :;.\-]+$', '')"
_WORDS_OF = "[" + ", ".join(f"'{w}'" for w in lay.HEADING_WORDS) + "]"


@query(
    rf"""WITH {_B}, c AS (SELECT *, {_KINDED} AS line, CASE ord % 5 WHEN 0 THEN 16.0::DOUBLE WHEN 1 THEN 8.0 WHEN 2 THEN 12.0 ELSE 10.0 END / 10.0 AS rank, ord % 5 < 3 AS bold, ord % 4 + 1 AS lines, y1 / 720 AS bottom, x0 > 100 AS centred,
      CASE WHEN ord % 8 = 7 AND length(text) < 60 THEN 'footer' WHEN ord % 8 = 0 AND length(text) < 30 THEN 'header' END AS margin, CASE WHEN ord % 29 = 3 THEN 'figure' WHEN ord % 31 = 3 THEN 'equation' END AS region, page = 0 AS first, ord < 3 AS title_like, ord BETWEEN 1 AND 4 AS author_like, ord >= 60 AS refs FROM b),
    s AS (SELECT *, {_KT} AS t, {_KBODY} AS body FROM c), w AS (SELECT *, list_transform(regexp_extract_all(body, '[\p{{L}}\p{{N}}_]+'), lambda x: lower(x)) AS words FROM s),
    z AS (SELECT *, t <> '' AND ((regexp_matches(body, '[.!?。！？;；:]\s*$') AND (len(words) >= 5 OR length(body) >= 28 OR list_has_any(words, {_VERBS}))) OR (len(words) >= 12 AND regexp_matches(body, '[,;，；]'))) AS sent, {_KL} AS label,
      lower(regexp_extract(t, '(?i)^(fig(?:ure)?|tab(?:le)?)\.?\s*(?:[0-9]+|[IVXLCDM]+)', 1)) AS cap, regexp_extract(t, '^([0-9]+(?:\.[0-9]+)*)\.?\s+\S', 1) AS dec, regexp_extract(t, '^([IVXLCDM]+)(?:\.[0-9]+)*\.?\s+\S', 1) AS rom, regexp_extract(t, '^[IVXLCDM]+((?:\.[0-9]+)*)\.?\s+\S', 1) AS suf FROM w),
    d AS (SELECT *, CASE WHEN dec <> '' THEN length(dec) - length(replace(dec, '.', '')) + 1 WHEN rom <> '' THEN length(suf) - length(replace(suf, '.', '')) + 1 END AS depth FROM z)
    SELECT uid, CASE WHEN margin IS NOT NULL AND NOT (first AND (title_like OR author_like)) THEN margin WHEN t = '' THEN 'unknown' WHEN region IS NOT NULL THEN region WHEN cap <> '' THEN CASE WHEN starts_with(cap, 'fig') THEN 'figure_caption' ELSE 'table_caption' END
      WHEN regexp_matches(t, '{lay.NUMBERED_LIST_SHAPE}') THEN 'list' WHEN regexp_matches(t, '{lay.FORMULA_SHAPE}') AND length(t) <= 200 AND NOT sent THEN 'equation' WHEN len(regexp_split_to_array(t, '\s*\|\s*')) >= 3 AND NOT sent THEN 'table'
      WHEN first AND title_like AND rank >= 1.35 AND lines <= 3 AND length(t) <= 180 AND NOT sent THEN 'title' WHEN first AND author_like AND regexp_matches(t, '{lay.AUTHOR_SHAPE}') AND NOT sent THEN 'author' WHEN label IN ('abstract', 'summary') THEN 'abstract'
      WHEN depth IS NOT NULL AND NOT sent AND length(t) <= 180 THEN CASE WHEN depth = 1 THEN 'heading' ELSE 'subheading' END WHEN list_contains({_WORDS_OF}, label) AND length(t) <= 120 THEN 'heading'
      WHEN rank >= 1.12 AND bold AND lines <= 2 AND length(t) <= 140 AND NOT sent THEN CASE WHEN rank < 1.35 THEN 'subheading' ELSE 'heading' END WHEN rank <= 0.85 AND bottom >= 0.8 THEN 'footnote' WHEN regexp_matches(t, '{lay.BULLET_SHAPE}') THEN 'list'
      WHEN regexp_matches(t, '{lay.CITATION_SHAPE}') OR (refs AND regexp_matches(t, '{lay.AUTHOR_YEAR_SHAPE}')) THEN 'reference' WHEN sent OR length(t) > 90 THEN 'paragraph' ELSE 'unknown' END AS kind FROM d"""
)
def block_kinds(t: Tables) -> DataFrame:
    """Lines dressed as every kind of block, with type and place by their number."""
    o = F.col("ord")
    b = _blocks(t).withColumn("line", F.expr(_KINDED))
    b = b.select(
        "uid", F.col("line").alias("text"), F.when(o % 5 == 0, 16.0).when(o % 5 == 1, 8.0).when(o % 5 == 2, 12.0).otherwise(10.0).alias("size"), F.lit(10.0).alias("body_size"), (o % 5 < 3).alias("bold"), (o % 4 + 1).alias("lines"),
        (F.col("y0") / 720).alias("top"), (F.col("y1") / 720).alias("bottom"), (F.col("x0") > 100).alias("centred"),
        F.when((o % 8 == 7) & (F.length("text") < 60), "footer").when((o % 8 == 0) & (F.length("text") < 30), "header").alias("margin"), F.when(o % 29 == 3, "figure").when(o % 31 == 3, "equation").alias("region"),
        (F.col("page") == 0).alias("first_page"), (o < 3).alias("title_like"), o.between(1, 4).alias("author_like"), (o >= 60).alias("in_references"),
    )
    return lay.block_kinds(b).select("uid", "kind")


@query()
def page_columns(t: Tables) -> DataFrame:
    """Pages of eight lines, set in two columns where the page is even: every second line stands on the right."""
    from lodestrand.operators.columns import page_columns

    o, two = F.col("ord"), F.col("page") % 2 == 0
    right = two & (o % 2 == 1)
    x0 = F.when(right, 320.0).otherwise(40.0)
    wide = F.when(two, F.least(F.length("text") * 1.0, F.lit(240.0))).otherwise(F.col("x1") - F.col("x0"))
    b = _blocks(t).withColumn("x0", x0).withColumn("x1", x0 + wide).withColumn("y0", F.when(two, F.floor(o % 8 / 2) * 180.0).otherwise(F.col("y0")))
    return page_columns(b.withColumn("y1", F.col("y0") + 60).withColumn("height", F.lit(720.0)))


# ---- boxes against boxes ----

_SHIFT = "x0 + (ord * 37) % 50 AS x0, y0 + (ord * 13) % 40 AS y0, x1 + (ord * 37) % 50 AS x1, y1 + (ord * 29) % 160 AS y1"
_RB = f"{_B}, bx AS (SELECT doc_id, page, uid, ord, text, {_SHIFT} FROM b WHERE x1 > x0), rg AS (SELECT * FROM bx WHERE ord % 3 = 1), bl AS (SELECT * FROM bx WHERE ord % 3 <> 1)"
_COMMON = "greatest(least(bl.x1, rg.x1) - greatest(bl.x0, rg.x0), 0) * greatest(least(bl.y1, rg.y1) - greatest(bl.y0, rg.y0), 0)"


def _shifted(t: Tables) -> DataFrame:
    """Lines of documents as boxes moved out of their rows, so that some overlap."""
    b = _blocks(t).where("x1 > x0")
    return b.select("doc_id", "page", "uid", "ord", "text", *(F.expr(x) for x in _SHIFT.split(", ")))


@query(f"WITH {_RB} SELECT DISTINCT bl.doc_id, bl.page, bl.uid FROM bl JOIN rg USING (doc_id, page) WHERE {_COMMON} > 0 AND {_COMMON} / greatest((bl.x1 - bl.x0) * (bl.y1 - bl.y0), 1.0) >= 0.2")
def blocks_in_regions(t: Tables) -> DataFrame:
    """Blocks of which a region of their page covers a fifth."""
    b = _shifted(t)
    return rg.within_regions(b.where("ord % 3 <> 1"), b.where("ord % 3 = 1"))


@query(f"WITH {_RB} SELECT bl.doc_id, bl.page, bl.uid, count(*) AS n, max({_COMMON}) AS most, sum({_COMMON}) AS total FROM bl JOIN rg ON bl.doc_id = rg.doc_id AND bl.page = rg.page AND least(bl.x1, rg.x1) >= greatest(bl.x0, rg.x0) AND least(bl.y1, rg.y1) >= greatest(bl.y0, rg.y0) GROUP BY ALL")
def covered_areas(t: Tables) -> DataFrame:
    """Of each block, how many regions meet it and what they cover."""
    b = _shifted(t)
    found = rg.meeting(b.where("ord % 3 <> 1"), b.where("ord % 3 = 1"))
    return found.groupBy("doc_id", "page", F.col("a_uid").alias("uid")).agg(F.count(F.lit(1)).alias("n"), F.max("common").alias("most"), F.sum("common").alias("total"))


@query()
def drawing_clusters(t: Tables) -> DataFrame:
    return rg.clusters(_shifted(t).where("ord % 2 = 0"))


@query()
def figure_regions(t: Tables) -> DataFrame:
    """Every third line of a page as an image, others as drawings or as blocks."""
    b = _shifted(t)
    images = b.where("ord % 3 = 0").withColumn("xref", F.col("ord") % 7).withColumn("signature", F.concat(F.lit("s"), (F.col("ord") % 2).cast("string")))
    blocks = b.where("ord % 3 = 2").withColumn("kind", F.when(F.col("ord") % 4 == 2, "table").otherwise("paragraph"))
    pages = b.select("doc_id", "page").distinct().select("*", F.lit(600.0).alias("width"), F.lit(720.0).alias("height"))
    return rg.figures(images, b.where("ord % 3 = 1"), blocks, pages, least=0.001)


def _formulas(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines of a page in one column: every fourth a formula of its first words, some with a label beside or a number at their end."""
    # Written once: the three frames are read several times, and each time would cut all texts into lines.
    lines = materialize(_blocks(t).where("x1 > x0").select("doc_id", "page", "ord", "uid", "text"), "lines")
    b = lines.withColumn("y0", F.col("ord") % 8 * 60.0).withColumn("y1", F.col("y0") + 20).withColumn("x0", F.lit(50.0)).withColumn("x1", F.lit(250.0)).withColumn("section", F.lit(None).cast("string"))
    first = F.concat_ws(" = ", F.element_at(F.split("text", " "), 1), F.element_at(F.split("text", " "), -1))
    numbered_ = F.when(F.col("ord") % 8 == 4, F.concat(first, F.lit(" ("), F.col("page") + 1, F.lit(")"))).otherwise(first)
    e = b.where("ord % 4 = 0").withColumn("text", numbered_)
    labels = b.where("ord % 8 = 0").withColumn("uid", F.concat("uid", F.lit("-label"))).withColumn("text", F.concat(F.lit("("), F.col("ord") + 1, F.lit(")"))).withColumn("x0", F.lit(300.0)).withColumn("x1", F.lit(320.0))
    blocks = e.unionByName(labels).unionByName(b.where("ord % 4 <> 0"))
    return e, blocks, b.select("doc_id", "page").distinct().withColumn("width", F.lit(280.0))


@query()
def assembled_equations(t: Tables) -> DataFrame:
    return rg.equations(*_formulas(t))


def _tabular(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first twelve words of each page's first line as a table of four rows: ruled, with pipes, below a caption, or bare, by turns of documents."""
    words = F.slice(F.filter(F.split("text", " "), lambda w: w != ""), 1, 12)
    # Written once: it is read for each kind of page, and each time would cut all texts into lines.
    p = materialize(_blocks(t).where("ord % 8 = 0").select("doc_id", "page", words.alias("w"), (F.col("doc_id") % 4).alias("turn")).where("size(w) = 12"), "tabular")
    cells = p.select("doc_id", "page", "turn", F.posexplode("w").alias("i", "text")).withColumn("text", F.concat("text", F.when(F.col("i") < 3, F.col("i").cast("string")).otherwise("")))
    row, col = F.floor(F.col("i") / 3), F.col("i") % 3
    apart = cells.where("turn <> 1").select("doc_id", "page", "text", (60 + col * 150.0).alias("x0"), (110 + row * 30.0).alias("y0"), (160 + col * 150.0).alias("x1"), (122 + row * 30.0).alias("y1"))
    piped = cells.where("turn = 1").groupBy("doc_id", "page", row.alias("r")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), " | ").alias("text"))
    piped = piped.select("doc_id", "page", "text", F.lit(60.0).alias("x0"), (110 + F.col("r") * 30.0).alias("y0"), F.lit(460.0).alias("x1"), (122 + F.col("r") * 30.0).alias("y1"))
    caption = p.where("turn IN (1, 2)").select("doc_id", "page", F.concat(F.lit("Table "), F.col("page") + 1, F.lit(": words")).alias("text"), F.lit(60.0).alias("x0"), F.lit(80.0).alias("y0"), F.lit(200.0).alias("x1"), F.lit(92.0).alias("y1"))
    at = F.explode(F.array(*[F.struct(F.lit(x0).alias("x0"), F.lit(y0).alias("y0"), F.lit(x1).alias("x1"), F.lit(y1).alias("y1")) for x0, y0, x1, y1 in [*((50.0 + 150 * i, 100.0, 51.0 + 150 * i, 221.0) for i in range(4)), *((50.0, 100.0 + 30 * i, 501.0, 101.0 + 30 * i) for i in range(5))]]))
    lines = p.where("turn = 0").select("doc_id", "page", at.alias("l")).select("doc_id", "page", "l.*")
    return p.select("doc_id", "page", F.lit(600.0).alias("width"), F.lit(720.0).alias("height")), apart.unionByName(piped).unionByName(caption), lines


@query()
def table_cascade(t: Tables) -> DataFrame:
    return found_tables.tables(*_tabular(t))
