"""Queries on outlines that are made from documents: first line the root, later lines its children, source and id the page, language the frontmatter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notespan.functions import columns as C
from notespan.operators import chunks, editing, merge, outline, places, table_functions
from notespan.operators.store import Store
from notespan.sources.work import work_folder, written


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, lang, lines and the outline's text."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null and doc_id is not null")
    lines = F.split(F.translate("text", "\r", " "), "\n")
    d = d.select("doc_id", "source", F.concat_ws("/", F.coalesce("source", F.lit("")), "doc_id").alias("page"), F.coalesce("lang", F.lit("")).alias("lang"), lines.alias("lines"))
    body = F.array_join(F.transform("lines", lambda x, i: F.concat(F.when(i == 0, "- ").otherwise("  - "), x)), "\n")
    return d.withColumn("text", F.concat(F.lit("lang:: "), "lang", F.lit("\n"), body))


LINES = """
WITH l AS (
  SELECT doc_id, source, concat(coalesce(source, ''), '/', doc_id) AS page, coalesce(lang, '') AS lang, string_split(replace(text, chr(13), ' '), chr(10)) AS lines
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), b AS (
  SELECT doc_id, source, page, lang, lines, i - 1 AS seq, lines[i] AS line,
    'lang:: ' || lang || chr(10) || chr(10) || '- ' || lines[1] || CASE WHEN i > 1 THEN chr(10) || '  - ' || lines[i] ELSE '' END AS context
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM l)
), h AS (SELECT *, md5(page || '::' || context) AS hybrid_id FROM b)
"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.contexts(outline.parsed(documents(spark, sf_dir)))


def outline_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("page", "seq", "parent", "depth", F.array_join("content", "\n").alias("content"), "hybrid_id")


OUTLINE_BLOCKS = LINES + "SELECT page, CAST(seq AS INT) AS seq, CASE WHEN seq > 0 THEN 0 END AS parent, CASE WHEN seq > 0 THEN 1 ELSE 0 END AS depth, line AS content, hybrid_id FROM h"


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = outline.parsed(documents(spark, sf_dir))
    rows = chunks.page_chunks(parsed).union(chunks.block_chunks(outline.contexts(parsed)))
    return chunks.last_wins(rows, ["chunk_id"], ["chunk_seq"]).select("chunk_id", "page", "block_id", "chunk_seq", F.md5("document").alias("document_md5"))


CHUNK_ROWS = LINES + """
SELECT page || '::' || hybrid_id AS chunk_id, page, hybrid_id AS block_id, CAST(max(seq) AS INT) AS chunk_seq, md5(any_value('- ' || lines[1] || CASE WHEN seq > 0 THEN chr(10) || '  - ' || line ELSE '' END)) AS document_md5 FROM h GROUP BY ALL
UNION ALL SELECT page || '::__page__', page, '__page__', -1, md5('Page: ' || page || chr(10) || 'lang:: ' || lang) FROM l
"""


def render_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose outline, parsed and rendered, is the text it came from: all without empty bullets, which lose the space after them."""
    d = documents(spark, sf_dir)
    out = outline.rendered(outline.parsed(d)).select(F.col("page").alias("_page"), F.col("text").alias("rendered"))
    return d.join(out, F.col("page") == F.col("_page")).select("page", (F.col("text") == F.col("rendered")).alias("same"))


RENDER_ROUNDTRIP = LINES + "SELECT page, NOT list_contains(lines, '') AS same FROM l"


def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last line of each block where the page is shown."""
    rows = outline.parsed(documents(spark, sf_dir)).select("page", F.posexplode(F.transform("blocks", lambda b: F.size(b["content"]))).alias("seq", "n"))
    rows = rows.withColumn("after", F.sum("n").over(Window.partitionBy("page").orderBy("seq")))
    return rows.select("page", "seq", (F.col("after") - F.col("n")).alias("first_line"), (F.col("after") - 1).alias("last_line"))


LINE_OFFSETS = LINES + "SELECT page, CAST(seq AS INT) AS seq, CAST(seq AS BIGINT) AS first_line, CAST(seq AS BIGINT) AS last_line FROM h"


def block_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    context = F.concat(F.lit("\n- "), F.array_join("lines", "\n  "))
    return d.select("doc_id", C.block_title(context).alias("title"), C.snippet(F.array_join(F.transform("lines", lambda x, i: F.concat(F.when(i % 2 == 0, "\t- ").otherwise("  "), x)), "\n")).alias("snippet"))


BLOCK_TITLES = r"""
WITH l AS (SELECT doc_id, string_split(replace(text, chr(13), ' '), chr(10)) AS lines FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
t AS (SELECT doc_id, lines, regexp_replace(regexp_replace(trim('- ' || lines[1]), '^- ', ''), '^\s+|\s+$', '') AS f FROM l)
SELECT doc_id, CASE WHEN length(f) > 50 THEN substr(f, 1, 47) || '...' ELSE f END AS title,
  replace(array_to_string(list_filter(list_transform(lines, lambda x, i: CASE WHEN i % 2 = 1 THEN chr(9) || '- ' || x ELSE '  ' || x END), lambda x: regexp_matches(x, '^\s*-')), chr(10)), chr(9), '  ') AS snippet
FROM t
"""


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of lines made of a document's metadata, read back; lines that only hold an id go from the context."""
    d = documents(spark, sf_dir)
    lines = F.array(F.concat(F.lit("  title:: "), "page", F.lit(" ")), F.concat(F.lit("id:: "), F.col("doc_id").cast("string")), F.concat(F.lit("lang::"), "lang"), F.lit("plain text"))
    return d.select("doc_id", C.property_value(lines, "title").alias("title"), C.property_value(lines, "lang").alias("lang"), C.property_value(lines, "none").alias("none"), F.size(C.properties(lines)).cast("long").alias("n"), C.without_id_lines(F.array_join(lines, "\n")).alias("context"))


PROPERTIES = LINES + r"""
SELECT doc_id, page AS title, lang, CAST(NULL AS VARCHAR) AS none, 3::BIGINT AS n, '  title:: ' || page || ' ' || chr(10) || 'lang::' || lang || chr(10) || 'plain text' AS context FROM l
"""


def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last document of each text, and the first."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.md5(F.coalesce("text", F.lit(""))).alias("key"), "doc_id", "source")
    last, first = chunks.last_wins(d, ["key"], ["doc_id"]), chunks.first_wins(d, ["key"], ["doc_id"])
    return last.join(first.select("key", F.col("doc_id").alias("first_id")), "key")


LAST_WINS = """
SELECT md5(coalesce(text, '')) AS key, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source, min(doc_id) AS first_id FROM documents GROUP BY 1
"""


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files as they are, and an index of before: without Spanish ones, with old French ones, and with pages that are gone."""
    d = documents(spark, sf_dir)
    files = d.select("page", "lang", F.col("doc_id").cast("double").alias("mtime"))
    index = files.where("lang != 'es'").select(F.when(F.col("lang") == "de", F.concat(F.lit("old/"), "page")).otherwise(F.col("page")).alias("page"), (F.col("mtime") - F.when(F.col("lang") == "fr", 5.0).otherwise(0.0)).alias("mtime"))
    return files.select("page", "mtime"), index


VERSIONS = LINES + """
, files AS (SELECT page, CAST(doc_id AS DOUBLE) AS mtime FROM l),
idx AS (SELECT CASE WHEN lang = 'de' THEN 'old/' || page ELSE page END AS page, CAST(doc_id AS DOUBLE) - CASE WHEN lang = 'fr' THEN 5.0 ELSE 0.0 END AS mtime FROM l WHERE lang <> 'es'),
plan AS (
  SELECT coalesce(f.page, i.page) AS page, CASE WHEN f.page IS NULL THEN 'deleted' WHEN i.page IS NULL THEN 'new' WHEN abs(f.mtime - i.mtime) < 1e-6 THEN 'unchanged' ELSE 'modified' END AS state
  FROM files f FULL JOIN idx i ON f.page = i.page)
"""


def index_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.changes(*versions(spark, sf_dir))


INDEX_CHANGES = VERSIONS + "SELECT page, state FROM plan"


def index_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of before as a base, what the files changed as a second version beside it, and both read as one."""
    files, index = versions(spark, sf_dir)
    store = Store(spark, work_folder(spark), "page", "page string, mtime double")
    base = store.after(None, 1, index, index, {})
    plan = written(chunks.changes(files, store.read(base)))
    fresh = files.join(plan.where(F.col("state").isin("new", "modified")), "page", "left_semi")
    if not store.commit(base) or not store.commit(store.after(base, 1, fresh, plan.where("state != 'unchanged'"), {})):
        raise RuntimeError("somebody else writes to a new folder")
    return store.read(store.version())


INDEX_UPDATE = VERSIONS + """
SELECT page, mtime FROM idx WHERE page NOT IN (SELECT page FROM plan WHERE state IN ('deleted', 'modified'))
UNION ALL SELECT page, mtime FROM files WHERE page IN (SELECT page FROM plan WHERE state IN ('new', 'modified'))
"""


def decisions(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """A decision for every labelled document: good ones go under its page's root, toxic ones under a block that is not there, others replace the root."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = documents(spark, sf_dir).join(labels, "doc_id")
    root = rows.where("seq = 0").select("page", F.col("hybrid_id").alias("root_id"))
    action = F.when(F.col("quality") == 1, "add_under").otherwise("replace")
    target = F.when(F.col("toxic") == 1, "nowhere").otherwise(F.col("root_id"))
    return d.join(root, "page").select(F.concat(F.lit("k"), "doc_id").alias("knowledge_block_id"), F.col("doc_id").alias("seq"), F.col("page").alias("target_page"), action.alias("action"), target.alias("target_block_id"), F.concat(F.lit("noted "), "doc_id").alias("refined_text"))


def trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The outlines and their blocks, parsed once for all uses: written to the shared folder."""
    outlines = written(outline.parsed(documents(spark, sf_dir)))
    return outlines, written(merge.tree(outlines))


def apply_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, tree = trees(spark, sf_dir)
    found = merge.resolved(decisions(spark, sf_dir, tree), tree)
    return merge.merged(tree, found).select("page", "seq", F.col("level").alias("depth"), F.array_join("content", "\n").alias("content"), "block_id")


UUID = """
lower(substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || translate(substr(s, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(s, 18, 3) || '-' || substr(s, 21, 12))
"""
NAMED = f"sha1(unhex('{C.NAMESPACE.replace('-', '')}') || encode(%s))"
DECISIONS = LINES + f"""
, lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT page, doc_id, CASE WHEN quality = 1 THEN 'add_under' ELSE 'replace' END AS action, CASE WHEN toxic = 1 THEN 'nowhere' ELSE hybrid_id END AS target
  FROM h JOIN lab USING (doc_id) WHERE seq = 0
), n AS (SELECT *, {NAMED % "'k' || doc_id || ':' || page || ':' || action || ':' || target"} AS s FROM d),
u AS (SELECT *, {UUID} AS new_id, CASE WHEN target <> 'nowhere' THEN action WHEN action = 'add_under' THEN 'add_section' ELSE 'invalid' END AS done_as FROM n)
"""
MERGED = DECISIONS + """
, m AS (
SELECT page, CAST(seq AS INT) AS seq, CASE WHEN seq > 0 THEN 1 ELSE 0 END AS depth,
  CASE WHEN seq = 0 AND done_as = 'replace' THEN 'noted ' || h.doc_id || chr(10) || 'id:: ' || new_id ELSE line END AS content, CASE WHEN seq = 0 AND done_as = 'replace' THEN new_id END AS block_id
FROM h LEFT JOIN u USING (page)
UNION ALL
SELECT page, CAST(len(lines) AS INT), CASE WHEN done_as = 'add_under' THEN 1 ELSE 0 END, 'noted ' || u.doc_id || chr(10) || 'id:: ' || new_id, new_id FROM u JOIN l USING (page) WHERE done_as IN ('add_under', 'add_section')
)
"""
APPLY_MERGE = MERGED + "SELECT * FROM m"


def names(pages: DataFrame) -> DataFrame:
    """What decisions about pages (page, text) are resolved with: page, seq, block_id and hybrid_id of their blocks, written without contents."""
    return written(merge.tree(outline.parsed(pages)).select("page", "seq", "block_id", "hybrid_id"))


def merged_pages(pages: DataFrame, found: DataFrame) -> DataFrame:
    """page, text and whether it changed, of those pages (page, text) that decisions name, after them."""
    text = outline.file_text()
    return merge.applied(outline.parsed(pages), found).select("page", text.alias("text"), (~text.eqNullSafe(outline.file_text("before"))).alias("changed"))


def merge_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the pages that a merge changes."""
    pages = documents(spark, sf_dir).select("page", "text")
    rows = names(pages)
    found = merge.resolved(written(decisions(spark, sf_dir, rows)), rows)
    return merged_pages(pages, found).where("changed").select("page", F.md5("text").alias("text_md5"))


MERGE_RENDER = MERGED + """
, t AS (
  SELECT page, string_agg(repeat('  ', depth) || CASE WHEN split_part(content, chr(10), 1) = '' THEN '-' ELSE '- ' || split_part(content, chr(10), 1) END
    || CASE WHEN contains(content, chr(10)) THEN chr(10) || repeat('  ', depth) || '  ' || split_part(content, chr(10), 2) ELSE '' END, chr(10) ORDER BY seq) AS body FROM m GROUP BY page)
SELECT page, md5('lang:: ' || lang || chr(10) || body) AS text_md5 FROM t JOIN l USING (page) WHERE page IN (SELECT page FROM u WHERE done_as <> 'invalid')
"""


def provenance_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as journals: the roots of labelled ones get links to what they became, the later of two twice, which adds nothing."""
    outlines = written(outline.parsed(documents(spark, sf_dir)))
    roots = merge.tree(outlines, hash_pages=False).where("seq = 0").select("page", F.col("hybrid_id").alias("knowledge_block_id"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").join(documents(spark, sf_dir).select("doc_id", "page"), "doc_id").join(roots, "page")
    done = labels.select("knowledge_block_id", F.concat(F.lit("topic___"), "quality").alias("target_page"), F.concat(F.lit("n"), "quality").alias("new_id"), F.col("quality").alias("seq")).distinct()
    done = done.union(done.select("knowledge_block_id", "target_page", "new_id", F.col("seq") + 9))
    return outline.rendered(merge.with_provenance(outlines, done)).select("page", F.md5("text").alias("text_md5"))


PROVENANCE_APPEND = LINES + """
, k AS (SELECT page, md5(context) AS id FROM h WHERE seq = 0),
p AS (SELECT id, string_agg('[topic/' || quality || '](((n' || quality || ')))', ', ' ORDER BY quality) AS links FROM (SELECT DISTINCT id, quality FROM labels JOIN l USING (doc_id) JOIN k USING (page)) GROUP BY id),
t AS (
  SELECT h.page, any_value(lang) AS lang, string_agg(CASE WHEN seq > 0 THEN '  ' ELSE '' END || CASE WHEN line = '' THEN '-' ELSE '- ' || line END
    || CASE WHEN seq = 0 AND links IS NOT NULL THEN chr(10) || '  extracted-to:: ' || links ELSE '' END, chr(10) ORDER BY seq) AS body
  FROM h JOIN k ON k.page = h.page LEFT JOIN p ON p.id = k.id GROUP BY h.page)
SELECT page, md5('lang:: ' || lang || chr(10) || body) AS text_md5 FROM t
"""


def fallback_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir)
    found = merge.resolved(decisions(spark, sf_dir, rows), rows)
    link = C.provenance(F.when(F.col("action") == "replace", F.lit("[p](((x)))")), F.col("target_page"), F.col("new_id"))
    return found.select("knowledge_block_id", "done_as", "new_id", link.alias("extracted_to"), F.size(C.provenance_links(link)).cast("long").alias("n_links"))


FALLBACK_ACTIONS = DECISIONS + """
SELECT 'k' || doc_id AS knowledge_block_id, done_as, new_id, CASE WHEN action = 'replace' THEN '[p](((x))), ' ELSE '' END || '[' || page || '](((' || new_id || ')))' AS extracted_to,
  CASE WHEN action = 'replace' THEN 2 ELSE 1 END::BIGINT AS n_links FROM u
"""


def idempotent_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second run of the same decisions finds, in the pages that the first run wrote, and whether it changes a page."""
    pages = documents(spark, sf_dir).select("page", "text")
    rows = names(pages)
    todo = written(decisions(spark, sf_dir, rows))
    again = written(merged_pages(pages, merge.resolved(todo, rows)).select("page", "text"))
    found = written(merge.resolved(todo, names(again)))
    second = merged_pages(again, found).select(F.col("page").alias("target_page"), "changed")
    return found.join(second, "target_page").select("target_page", "knowledge_block_id", "done_as", "changed")


IDEMPOTENT_PROBE = DECISIONS + "SELECT page AS target_page, 'k' || doc_id AS knowledge_block_id, CASE WHEN done_as = 'invalid' THEN done_as ELSE 'done' END AS done_as, false AS changed FROM u"


def selected_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with a digit, without those below another one."""
    parsed = outline.parsed(documents(spark, sf_dir))
    rows = parsed.select("page", F.explode("blocks").alias("b")).select("page", "b.seq", "b.above", F.array_join("b.content", "\n").alias("content"))
    return outline.without_covered(rows, rows.where(F.col("content").rlike("[0-9]"))).select("page", "seq")


SELECTED_SUBTREES = LINES + """
, s AS (SELECT page, seq FROM h WHERE regexp_matches(line, '[0-9]'))
SELECT page, CAST(seq AS INT) AS seq FROM s WHERE seq = 0 OR page NOT IN (SELECT page FROM s WHERE seq = 0)
"""


def previous_sibling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block before each one under the same parent."""
    w = Window.partitionBy("page", "parent").orderBy("seq")
    return blocks(spark, sf_dir).select("page", "seq", F.lag("hybrid_id").over(w).alias("previous_id"))


PREVIOUS_SIBLING = LINES + "SELECT page, CAST(seq AS INT) AS seq, lag(hybrid_id) OVER (PARTITION BY page, seq > 0 ORDER BY seq) AS previous_id FROM h"


def clean_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = outline.parsed(documents(spark, sf_dir))
    rows = outline.contexts(parsed).select("page", "seq", "context").join(parsed.select("page", "frontmatter"), "page")
    return rows.select("page", "seq", F.md5(outline.for_model(F.col("context"), F.col("frontmatter"))).alias("context_md5"))


CLEAN_CONTEXT = LINES + "SELECT page, CAST(seq AS INT) AS seq, md5('- ' || lines[1] || CASE WHEN seq > 0 THEN chr(10) || '  - ' || line ELSE '' END) AS context_md5 FROM h"


def candidate_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item as a request, with the document of its id as what it may refer to."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("request"))
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("request"), "page", F.posexplode("lines").alias("seq", "document"))
    rows = d.join(items, "request").withColumn("block_id", F.concat_ws(":", "page", "seq"))
    return outline.as_xml(rows).select("request", F.md5("xml").alias("xml_md5"))


ESCAPE = "replace(replace(replace(replace(replace(%s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
CANDIDATE_XML = LINES + f"""
SELECT request, md5('<page name="' || page || '">' || string_agg('<block id="' || page || ':' || seq || '">' || {ESCAPE % "line"} || '</block>', '' ORDER BY seq) || '</page>') AS xml_md5
FROM (SELECT item_id AS request FROM benchmark) JOIN h ON h.doc_id = request GROUP BY request, page
"""


def outline_parse_quirks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages made of documents' metadata with a fence that a bullet opens, a blank line inside a block, a jump of levels, a misaligned bullet, an empty one and a line end at the end."""
    d = documents(spark, sf_dir)
    lines = [F.concat(F.lit("- ```"), "lang"), F.concat(F.lit("  - in "), "doc_id"), F.lit("  ```"), F.concat(F.lit("- b "), F.coalesce("source", F.lit(""))), *map(F.lit, ["  more", "", "  end", "    - deep", "   - odd", "-", "- last", ""])]
    parsed = outline.parsed(d.select("page", F.concat_ws("\n", *lines).alias("text")))
    rows = parsed.select("page", F.explode("blocks").alias("b")).select("page", "b.seq", "b.parent", "b.level", F.array_join("b.content", "|").alias("content"))
    return rows.join(outline.rendered(parsed).select("page", F.md5("text").alias("text_md5")), "page")


OUTLINE_PARSE_QUIRKS = LINES + """
, q AS (SELECT page, doc_id, lang, coalesce(source, '') AS source, md5(array_to_string(['- ```' || lang, '  - in ' || doc_id, '  ```', '- b ' || coalesce(source, ''), '  more', '  ', '  end', '    - deep', '      - odd', '-', '- last'], chr(10))) AS text_md5 FROM l)
SELECT page, seq, CAST(NULL AS INT) AS parent, level, content, text_md5 FROM (
  SELECT page, text_md5, 0 AS seq, 0 AS level, '```' || lang || '|- in ' || doc_id || '|```' AS content FROM q
  UNION ALL SELECT page, text_md5, 1, 0, 'b ' || source || '|more||end' FROM q
  UNION ALL SELECT page, text_md5, 2, 2, 'deep|- odd' FROM q
  UNION ALL SELECT page, text_md5, 3, 0, '' FROM q
  UNION ALL SELECT page, text_md5, 4, 0, 'last|' FROM q)
"""


def property_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with one property changed in place, its indent kept, and one added; what is a user's content; lines as bullets."""
    d = documents(spark, sf_dir)
    own = F.array(F.concat(F.lit("note "), "doc_id"), F.concat(F.lit("  lang:: "), "lang"), F.concat(F.lit("id:: "), "doc_id"), F.lit("tail"))
    new = editing.with_property(editing.with_property(own, "lang", F.concat(F.lit("x-"), "lang")), "seen", F.col("doc_id").cast("string"))
    text = F.concat(F.lit("one\n\n  two\n- "), "lang")
    line = editing.property_line(F.concat(F.lit("  page-id:: "), F.col("doc_id").cast("string")))
    return d.select("doc_id", F.array_join(new, "|").alias("edited"), editing.user_content(own).alias("content"), editing.as_bullets(text).alias("bullets"), F.concat_ws("|", line["indent"], line["key"], line["value"]).alias("property"))


PROPERTY_EDIT = LINES + """
SELECT doc_id, 'note ' || doc_id || '|  lang:: x-' || lang || '|id:: ' || doc_id || '|tail|seen:: ' || doc_id AS edited, 'note ' || doc_id || chr(10) || '  lang:: ' || lang || chr(10) || 'tail' AS content,
  '- one' || chr(10) || chr(10) || '  - two' || chr(10) || '- ' || lang AS bullets, '  |page-id|' || doc_id AS property FROM l
"""


def heading_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first block of each page whose first line has "TH", whatever its case, and what stands above it."""
    outlines = outline.parsed(documents(spark, sf_dir))
    rows = outlines.select("page", F.explode("blocks").alias("b")).select("page", "b.seq", "b.content")
    shown = editing.lineage(outlines).select("page", "seq", F.size("shown").cast("long").alias("n_shown"), F.md5(F.array_join("shown", "\n")).alias("shown_md5"))
    return editing.heading(rows, "TH").join(shown, ["page", "seq"])


HEADING_FIND = LINES + """
, f AS (SELECT page, min(seq) AS seq FROM h WHERE contains(lower(line), 'th') GROUP BY page)
SELECT page, CAST(seq AS INT) AS seq, CASE WHEN seq > 0 THEN 2 ELSE 1 END::BIGINT AS n_shown, md5(CASE WHEN seq > 0 THEN lines[1] || chr(10) || line ELSE line END) AS shown_md5 FROM f JOIN h USING (page, seq)
"""


def augmented_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block with an id line: the hash, without the page's name, of its context before any was added."""
    rows = editing.with_ids(outline.parsed(documents(spark, sf_dir)))
    return rows.select("page", F.explode("blocks").alias("b")).select("page", "b.seq", F.element_at("b.content", -1).alias("id_line"))


AUGMENTED_IDS = LINES + "SELECT page, CAST(seq AS INT) AS seq, 'id:: ' || md5(context) AS id_line FROM h"


def merge_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks of each page stay, are new and are shown beside what replaces them."""
    _, tree = trees(spark, sf_dir)
    rows = editing.preview(tree, merge.resolved(decisions(spark, sf_dir, tree), tree))
    return rows.groupBy("page").agg(*(F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("kept", "new", "old")))


MERGE_PREVIEW = DECISIONS + """
SELECT page, len(lines) - CASE WHEN done_as = 'replace' THEN 1 ELSE 0 END AS n_kept, CASE WHEN coalesce(done_as, 'invalid') <> 'invalid' THEN 1 ELSE 0 END::BIGINT AS n_new, CASE WHEN done_as = 'replace' THEN 1 ELSE 0 END::BIGINT AS n_old
FROM l LEFT JOIN u USING (page)
"""


def replacements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outlines of two blocks with properties of all kinds, the second with an id, their blocks, and four replacements of each page: two of the first block, two of the second."""
    d = documents(spark, sf_dir).select("doc_id", "page", "lang")
    lines = [F.concat(F.lit("- about "), "doc_id"), F.concat(F.lit("  ключ:: "), "lang"), F.lit("  my key:: v v"), F.concat(F.lit("  see http::x/"), "doc_id"), F.lit("  plain"), F.concat(F.lit("- kept "), "lang"), F.concat(F.lit("  id:: own-"), "doc_id"), F.lit("  -- no:: property"), F.lit("  k::")]
    outlines = written(outline.parsed(d.select("page", F.concat_ws("\n", *lines).alias("text"))))
    tree = written(merge.tree(outlines))
    first = tree.where("seq = 0").select("page", F.col("hybrid_id").alias("first_id"))
    todo = d.join(first, "page").select("doc_id", "page", F.posexplode(F.array("first_id", "first_id", F.concat(F.lit("own-"), "doc_id"), F.concat(F.lit("own-"), "doc_id"))).alias("n", "target_block_id"))
    return outlines, tree, todo.select(F.concat(F.lit("k"), "n").alias("knowledge_block_id"), (F.col("doc_id") * 4 + F.col("n")).alias("seq"), F.col("page").alias("target_page"), F.lit("replace").alias("action"), "target_block_id", F.concat(F.lit("text "), "n").alias("refined_text"))


def merge_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What replacements leave of a page's properties, and what becomes of the second replacement of a block."""
    outlines, tree, todo = replacements(spark, sf_dir)
    found = merge.resolved(todo, tree)
    text = outline.rendered(merge.regrouped(outlines, merge.merged(tree, found))).select(F.col("page").alias("target_page"), F.md5("text").alias("text_md5"))
    return found.join(text, "target_page").select("seq", "done_as", "beaten", "text_md5")


MERGE_PROPERTIES = LINES + f"""
, n AS (SELECT doc_id, page, lang, md5(page || '::' || array_to_string(['- about ' || doc_id, '  ключ:: ' || lang, '  my key:: v v', '  see http::x/' || doc_id, '  plain'], chr(10))) AS target FROM l),
s AS (SELECT *, {NAMED % "'k0:' || page || ':replace:' || target"} AS s FROM n),
t AS (SELECT doc_id, md5(array_to_string(['- text 0', '  ключ:: ' || lang, '  my key:: v v', '  see http::x/' || doc_id, '  id:: ' || {UUID.strip()}, '- text 3', '  id:: own-' || doc_id, '  k::'], chr(10))) AS text_md5 FROM s)
SELECT doc_id * 4 + n AS seq, CASE WHEN n = 1 THEN 'invalid' ELSE 'replace' END AS done_as, n = 1 AS beaten, text_md5 FROM t, range(4) AS r(n)
"""


def child_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of all pages with four children more below their roots: first, second, before the last and last."""
    outlines = written(outline.parsed(documents(spark, sf_dir)))
    rows = written(places.keyed(outlines))
    roots = rows.where("parent = ''").select("page", F.col("key").alias("parent"))
    new = roots.withColumn("turn", F.explode(F.array(*map(F.lit, range(4)))))
    at = F.when(F.col("turn") < 2, F.col("turn")).when(F.col("turn") == 2, -1)
    out = places.rendered(outlines, places.inserted(rows, new.select("page", "parent", at.alias("position"), "turn", F.array(F.concat(F.lit("new "), "turn")).alias("content"))))
    return out.select("page", F.md5("text").alias("text_md5"))


CHILD_POSITIONS = LINES + """
, c AS (SELECT page, lang, lines, len(lines) - 1 AS n FROM l),
p AS (
  SELECT page, seq AS spot, 0 AS kind, 0 AS turn, CASE WHEN line = '' THEN '  -' ELSE '  - ' || line END AS t FROM h WHERE seq > 0
  UNION ALL SELECT page, CASE turn WHEN 0 THEN 0 WHEN 1 THEN least(1, n) WHEN 2 THEN greatest(n - 1, 0) ELSE n END, 1, turn, '  - new ' || turn FROM c, range(4) AS r(turn)
), y AS (SELECT page, string_agg(t, chr(10) ORDER BY spot, kind, turn) AS body FROM p GROUP BY page)
SELECT page, md5('lang:: ' || lang || chr(10) || CASE WHEN lines[1] = '' THEN '-' ELSE '- ' || lines[1] END || chr(10) || body) AS text_md5 FROM c JOIN y USING (page)
"""


def preview_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each decision's page as it would be, and the ids of the new block and of the one that it replaces."""
    outlines, tree = trees(spark, sf_dir)
    rows = places.previewed(outlines, decisions(spark, sf_dir, tree))
    return rows.select("seq", "page", F.md5("text").alias("text_md5"), "highlight_id", "old_id")


PREVIEW_HIGHLIGHTS = DECISIONS + """
, k AS (
  SELECT u.doc_id AS seq, u.page, u.done_as, l.lang, CASE WHEN lines[1] = '' THEN '-' ELSE '- ' || lines[1] END AS root, '- ' || lines[1] AS shown, 'noted ' || u.doc_id AS noted, lines FROM u JOIN l USING (page)
), y AS (SELECT *, array_to_string(list_transform(lines[2:], lambda x: CASE WHEN x = '' THEN '  -' ELSE '  - ' || x END), chr(10)) AS body, len(lines) > 1 AS more FROM k)
SELECT seq, page, md5('lang:: ' || lang || chr(10) || CASE done_as
    WHEN 'replace' THEN root || chr(10) || '- ' || noted || CASE WHEN more THEN chr(10) || body ELSE '' END
    ELSE root || CASE WHEN more THEN chr(10) || body ELSE '' END || CASE done_as WHEN 'add_under' THEN chr(10) || '  - ' || noted WHEN 'add_section' THEN chr(10) || '- ' || noted ELSE '' END END) AS text_md5,
  CASE done_as WHEN 'invalid' THEN NULL WHEN 'add_under' THEN md5(page || '::lang:: ' || lang || chr(10) || chr(10) || shown || chr(10) || '  - ' || noted) ELSE md5(page || '::lang:: ' || lang || chr(10) || chr(10) || '- ' || noted) END AS highlight_id,
  CASE WHEN done_as = 'replace' THEN md5(page || '::lang:: ' || lang || chr(10) || chr(10) || shown) END AS old_id
FROM y
"""


def lateral_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index rows of all pages, as a query with a table function has them."""
    table_functions.register(spark)
    pages = documents(spark, sf_dir).select("page", "text")
    return spark.sql("SELECT chunk_id, page, block_id, chunk_seq, md5(document) AS document_md5 FROM {pages}, LATERAL chunks(page, text)", pages=pages)


LATERAL_CHUNKS = CHUNK_ROWS


def request_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item as a request that may refer to the page of its id and that page's blocks, as a model gets them."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("request"))
    d = documents(spark, sf_dir).withColumnRenamed("doc_id", "request").join(items, "request").withColumn("frontmatter", F.concat(F.lit("lang:: "), "lang", F.lit("\n ")))
    page = d.select("request", "page", F.lit(-1).alias("seq"), F.lit("p").alias("block_id"), F.concat(F.lit("Page: "), "page", F.lit("\nlang:: "), "lang").alias("document"), "frontmatter", F.lit(True).alias("of_page"))
    blocks = d.select("request", "page", F.posexplode("lines").alias("seq", "document"), "frontmatter").select("request", "page", "seq", F.concat_ws("<", "page", "seq").alias("block_id"), "document", "frontmatter", F.lit(False).alias("of_page"))
    return outline.pages_xml(page.union(blocks)).select("request", F.md5("xml").alias("xml_md5"))


REQUEST_XML = LINES + """
SELECT request, md5('<pages>' || chr(10) || '<page name="' || page || '">' || chr(10) || '<properties>' || chr(10) || 'lang:: ' || any_value(lang) || chr(10) || '</properties>' || chr(10) || '<block id="p">' || chr(10) || 'Page: ' || page || chr(10) || '</block>' || chr(10)
  || string_agg('<block id="' || page || '&lt;' || seq || '">' || chr(10) || line || chr(10) || '</block>', chr(10) ORDER BY seq) || chr(10) || '</page>' || chr(10) || '</pages>') AS xml_md5
FROM (SELECT item_id AS request FROM benchmark) JOIN h ON h.doc_id = request GROUP BY request, page
"""


def block_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.block_total(outline.parsed(documents(spark, sf_dir)))


BLOCK_TOTAL = LINES + "SELECT CAST(count(*) AS BIGINT) AS n_roots, CAST(sum(len(lines)) AS BIGINT) AS n_blocks FROM l"
