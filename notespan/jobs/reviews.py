"""Queries on model output and its review: events as decisions, labels as suggestions, conversations as requests, pages as search results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notespan.functions import columns as C
from notespan.operators import chunks, runs
from notespan.operators import decisions as D
from notespan.sources import graph as G


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a decision of its user's block about the page of its type."""
    k = F.get_json_object("props", "$.k").cast("int")
    action = F.when(k < 25, "add_section").when(k < 50, "add_under").when(k < 75, "replace").otherwise("skip_exists")
    status = F.when(F.col("value") < 5, "failed").when(F.col("value") < 50, "completed").otherwise("pending")
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("b"), "user_id").alias("knowledge_block_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("target_page"), action.alias("action"),
        F.when(~action.isin("add_section"), F.concat(F.lit("t"), k % 7)).alias("target_block_id"), F.round(F.col("value") / (F.col("value") + 20), 6).alias("confidence"), status.alias("write_status"),
    )


DECIDED = """
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
a AS (SELECT *, CASE WHEN k < 25 THEN 'add_section' WHEN k < 50 THEN 'add_under' WHEN k < 75 THEN 'replace' ELSE 'skip_exists' END AS action FROM e),
d AS (
  SELECT 'b' || user_id AS knowledge_block_id, event_id AS seq, event_type AS target_page, action, CASE WHEN action <> 'add_section' THEN 't' || (k % 7) END AS target_block_id,
    round(value / (value + 20), 6) AS confidence, CASE WHEN value < 5 THEN 'failed' WHEN value < 50 THEN 'completed' ELSE 'pending' END AS write_status
  FROM a)
"""


def decision_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision for each page, action and target: the first, whichever block it is of."""
    return chunks.first_wins(decided(spark, sf_dir), ["target_page", "action", "target_block_id"], ["seq"]).select("target_page", "action", "target_block_id", "seq", "knowledge_block_id")


DECISION_DEDUPE = DECIDED + "SELECT target_page, action, target_block_id, min(seq) AS seq, arg_min(knowledge_block_id, seq) AS knowledge_block_id FROM d GROUP BY 1, 2, 3"


def decisions_by_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.by_block(decided(spark, sf_dir))


DECISIONS_BY_BLOCK = DECIDED + "SELECT knowledge_block_id, count(*) AS n_decisions, count(DISTINCT target_page) AS n_pages, bool_and(action = 'skip_exists') AS all_skipped FROM d GROUP BY 1"


def decision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.summary(decided(spark, sf_dir))


DECISION_SUMMARY = DECIDED + "SELECT count(*) AS n_decisions, count(*) FILTER (write_status = 'pending') AS n_pending, count(*) FILTER (write_status = 'completed') AS n_completed, count(*) FILTER (write_status = 'failed') AS n_failed FROM d"


def best_two_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.best_for_each_page(decided(spark, sf_dir)).select("knowledge_block_id", "target_page", "rank", "seq", "confidence")


BEST_TWO_PER_PAGE = DECIDED + """
SELECT * FROM (SELECT knowledge_block_id, target_page, row_number() OVER (PARTITION BY knowledge_block_id, target_page ORDER BY confidence DESC, seq) AS rank, seq, confidence FROM d) WHERE rank <= 2
"""


def batch_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions that a batch accept writes: pending, and not about what exists already; with the deterministic id."""
    rows = decided(spark, sf_dir).where("write_status = 'pending' and action != 'skip_exists'")
    return rows.select("seq", C.integration_id(F.col("knowledge_block_id"), F.col("target_page"), F.col("action"), F.col("target_block_id")).alias("id"))


NAMED = f"sha1(unhex('{C.NAMESPACE.replace('-', '')}') || encode(%s))"
UUID = "lower(substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || translate(substr(s, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(s, 18, 3) || '-' || substr(s, 21, 12))"
BATCH_ACCEPT = DECIDED + f"SELECT seq, {UUID} AS id FROM (SELECT seq, {NAMED % "concat_ws(':', knowledge_block_id, target_page, action, target_block_id)"} AS s FROM d WHERE write_status = 'pending' AND action <> 'skip_exists')"


def record_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions written as a model's stream, some broken, decoded and validated again."""
    d = decided(spark, sf_dir)
    record = F.to_json(F.struct("knowledge_block_id", "target_page", "action", F.when(F.col("confidence") > 0.2, F.col("target_block_id")).alias("target_block_id"), (F.col("confidence") * 1.2).alias("confidence")))
    line = F.when(F.col("write_status") == "failed", F.concat(F.lit("data: "), F.substring(record, 1, 30))).when(F.col("write_status") == "pending", F.lit("data: [DONE]")).otherwise(F.concat(F.lit("data: "), record))
    return D.decoded(d.select("seq", line.alias("line"))).select("seq", "knowledge_block_id", "target_page", "action", "target_block_id", F.round("confidence", 6).alias("confidence"))


RECORD_VALIDATE = DECIDED + """
, r AS (SELECT seq, knowledge_block_id, target_page, action, CASE WHEN confidence > 0.2 THEN target_block_id END AS target_block_id, confidence * 1.2 AS confidence FROM d WHERE write_status = 'completed')
SELECT seq, knowledge_block_id, target_page, action, target_block_id, round(confidence, 6) AS confidence FROM r
WHERE confidence BETWEEN 0 AND 1 AND (action NOT IN ('replace', 'skip_exists') OR target_block_id IS NOT NULL)
"""


def stream_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as streamed pieces of both kinds of server, and the text in them."""
    c = read(spark, sf_dir, "conversations")
    one = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    two = F.to_json(F.struct(F.struct(F.col("text").alias("content")).alias("message")))
    line = F.when(F.col("role") == "user", F.concat(F.lit("data: "), one)).when(F.col("role") == "assistant", two).otherwise(F.lit("data: [DONE]"))
    return c.select("conv_id", "turn", F.md5(D.delta(D.stream_record(line))).alias("text_md5"))


STREAM_DELTAS = "SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant') THEN md5(text) END AS text_md5 FROM conversations"


def id_shorten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is a request; its texts get numbers by first appearance, and numbers back to texts; replies name one too many."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5("text").alias("block"))
    short = chunks.numbered(c, "conv_id", "block", "turn")
    replies = c.select(F.col("conv_id"), (F.col("turn") + 1).alias("short"), F.lit(True).alias("named"))
    return short.join(replies.distinct(), ["conv_id", "short"], "left").select("conv_id", "block", "short", F.coalesce("named", F.lit(False)).alias("named"))


ID_SHORTEN = """
WITH c AS (SELECT conv_id, turn, md5(text) AS block FROM conversations),
f AS (SELECT conv_id, block, min(turn) AS place FROM c GROUP BY 1, 2),
s AS (SELECT conv_id, block, row_number() OVER (PARTITION BY conv_id ORDER BY place, block) AS short FROM f)
SELECT conv_id, block, short, EXISTS (SELECT 1 FROM c WHERE c.conv_id = s.conv_id AND c.turn + 1 = s.short) AS named FROM s
"""


def invalid_id_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies whose number no text has are dropped; how many stay in each conversation."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5("text").alias("block"))
    replies = c.select("conv_id", (F.col("turn") * 2).alias("short"))
    return replies.join(chunks.numbered(c, "conv_id", "block", "turn"), ["conv_id", "short"]).groupBy("conv_id").agg(F.count("*").alias("n"))


INVALID_ID_DROP = """
WITH c AS (SELECT conv_id, turn, md5(text) AS block FROM conversations), n AS (SELECT conv_id, count(DISTINCT block) AS n FROM c GROUP BY 1)
SELECT conv_id, count(*) AS n FROM c JOIN n USING (conv_id) WHERE turn * 2 BETWEEN 1 AND n.n GROUP BY conv_id
"""


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state for every document, with labels as the model's suggestions; two for a document: the later wins."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("block_id"), "n_chars")
    own = d.select("block_id", F.when(F.col("n_chars") > 5000, "knowledge").otherwise("pending").alias("classification"), F.when(F.col("n_chars") > 5000, 1.0).alias("confidence"), F.lit("user").alias("source"))
    n = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("block_id"), F.when(F.col("toxic") == 0, "knowledge").otherwise("other").alias("llm_classification"), (F.col("quality") * 0.9).alias("llm_confidence"), F.lit("label").alias("reason"), F.col("doc_id").alias("seq"))
    return D.with_suggestions(own, n)


STATES = """
WITH s AS (
  SELECT d.doc_id AS block_id, CASE WHEN n_chars > 5000 THEN 'knowledge' ELSE 'pending' END AS classification, CASE WHEN n_chars > 5000 THEN 1.0 END::DOUBLE AS confidence,
    CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 0 THEN 'knowledge' ELSE 'other' END AS llm_classification, (l.quality * 0.9)::DOUBLE AS llm_confidence
  FROM documents d LEFT JOIN labels l USING (doc_id)), t AS (SELECT *, coalesce(classification <> 'knowledge' AND llm_classification = 'knowledge' AND llm_confidence >= 0.8, false) AS take FROM s)
"""


def state_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(spark, sf_dir).select("block_id", D.label().alias("label"))


STATE_LABELS = STATES + "SELECT block_id, CASE WHEN classification = 'knowledge' THEN 'selected' WHEN take THEN 'suggested' ELSE 'none' END AS label FROM t"


def accept_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.accept_all(states(spark, sf_dir)).select("block_id", "classification", "source", "confidence")


ACCEPT_ALL = STATES + "SELECT block_id, CASE WHEN take THEN 'knowledge' ELSE classification END AS classification, CASE WHEN take THEN 'llm' ELSE 'user' END AS source, CASE WHEN take THEN llm_confidence ELSE confidence END AS confidence FROM t"


def toggle_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long documents toggled, then all with a suggestion reset to it."""
    s = D.toggled(states(spark, sf_dir), F.col("classification") == "knowledge")
    return D.reset(s).select("block_id", "classification", "source", "confidence")


TOGGLE_RESET = STATES + "SELECT block_id, coalesce(llm_classification, 'pending') AS classification, CASE WHEN llm_classification IS NOT NULL THEN 'llm' ELSE 'user' END AS source, CASE WHEN llm_classification IS NOT NULL THEN llm_confidence ELSE confidence END AS confidence FROM t"


def confidence_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(spark, sf_dir).agg(F.coalesce(F.min("llm_confidence"), F.lit(0.0)).alias("low"), F.coalesce(F.max("llm_confidence"), F.lit(1.0)).alias("high"), F.count_if(F.col("classification") == "knowledge").alias("n_selected"), F.count_if(D.suggested()).alias("n_suggested"))


CONFIDENCE_RANGE = STATES + "SELECT coalesce(min(llm_confidence), 0) AS low, coalesce(max(llm_confidence), 1) AS high, count(*) FILTER (classification = 'knowledge') AS n_selected, count(*) FILTER (llm_classification = 'knowledge' AND llm_confidence >= 0.8) AS n_suggested FROM t"


def next_match_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each conversation, from every turn the next one of the user, around the end."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return runs.matched(c, F.col("role") == "user", "turn", ["conv_id"]).select("conv_id", "turn", F.col("next_at").alias("next_turn"))


NEXT_MATCH_WRAP = """
SELECT conv_id, turn, coalesce((SELECT min(o.turn) FROM conversations o WHERE o.conv_id = c.conv_id AND o.role = 'user' AND o.turn > c.turn),
  (SELECT min(o.turn) FROM conversations o WHERE o.conv_id = c.conv_id AND o.role = 'user')) AS next_turn FROM conversations c
"""


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", C.deep_link(F.lit("my notes"), F.col("url"), F.when(F.col("page_id") < 100, F.col("page_id").cast("string"))).alias("link"), C.xml_escape(F.col("url")).alias("escaped"), C.store_name(F.col("url")).alias("store"), C.display_name(F.translate(F.regexp_replace("url", "/", "___"), ":", "")).alias("shown"))


PAGE_URLS = """
SELECT page_id, 'notes://graph/my%20notes?' || CASE WHEN page_id < 100 THEN 'block-id=' || page_id ELSE 'page=' || url_encode(url) END AS link,
  replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped,
  regexp_extract(url, '([^/]*)/*$', 1) || '-' || substr(sha256(url), 1, 16) AS store, replace(url, ':', '') AS shown FROM pages
"""


def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a page, written as note links and read back, and how many pages have each."""
    p = read(spark, sf_dir, "pages")
    context = F.array_join(F.transform(F.regexp_extract_all("html", F.lit(r'href="/([^"\]\[]+)"'), F.lit(1)), lambda x: F.concat(F.lit("see [["), x, F.lit("]]"))), " ")
    return p.select(F.explode(C.page_links(context)).alias("link")).groupBy("link").agg(F.count("*").alias("n_pages"))


LINK_EXTRACT = r"""SELECT link, count(*) AS n_pages FROM (SELECT unnest(list_distinct(regexp_extract_all(html, 'href="/([^"\]\[]+)"', 1))) AS link FROM pages) GROUP BY link"""


def journal_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day from the first order to the last; what it has, or that it has nothing."""
    o = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), "o_totalprice")
    ends = o.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = ends.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    n = o.groupBy("day").agg(F.count("*").alias("n"))
    return days.join(n, "day", "left").select(F.translate(F.col("day").cast("string"), "-", "_").alias("stem"), F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))


JOURNAL_LOOKUP = """
WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), d AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM o), (SELECT max(day) FROM o), INTERVAL 1 DAY)) AS DATE) AS day)
SELECT replace(CAST(day AS VARCHAR), '-', '_') AS stem, coalesce(n, 0) AS n, n IS NULL AS missing FROM d LEFT JOIN o USING (day)
"""


def combined_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns in order, as one text with a heading for each."""
    c = read(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("# "), "role", F.lit("\n"), "text").alias("t"))))
    return c.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.md5(F.array_join(F.transform("turns", lambda x: x["t"]), "\n\n")).alias("text_md5"))


COMBINED_JOURNAL = "SELECT conv_id, md5(string_agg('# ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY turn, '# ' || role || chr(10) || text)) AS text_md5 FROM conversations GROUP BY conv_id"


def previous_match_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each conversation, from every turn the user's turn before it, around the beginning."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return runs.matched(c, F.col("role") == "user", "turn", ["conv_id"]).select("conv_id", "turn", F.col("previous_at").alias("previous_turn"))


PREVIOUS_MATCH_WRAP = """
SELECT conv_id, turn, coalesce((SELECT max(o.turn) FROM conversations o WHERE o.conv_id = c.conv_id AND o.role = 'user' AND o.turn < c.turn),
  (SELECT max(o.turn) FROM conversations o WHERE o.conv_id = c.conv_id AND o.role = 'user')) AS previous_turn FROM conversations c
"""


def decision_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block's decisions in order, as text."""
    rows = D.listed_by_block(decided(spark, sf_dir))
    one = F.transform("decisions", lambda x: F.concat_ws(":", x["seq"], x["target_page"], x["action"], x["target_block_id"]))
    return rows.select("knowledge_block_id", F.md5(F.array_join(one, ",")).alias("decisions_md5"), "all_skipped")


DECISION_LISTS = DECIDED + "SELECT knowledge_block_id, md5(string_agg(concat_ws(':', seq, target_page, action, target_block_id), ',' ORDER BY seq)) AS decisions_md5, bool_and(action = 'skip_exists') AS all_skipped FROM d GROUP BY 1"


def recorded_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.recorded_already(decided(spark, sf_dir))


RECORDED_BLOCKS = DECIDED + "SELECT count(*) FILTER (s) AS n_recorded FROM (SELECT bool_and(action = 'skip_exists') AS s FROM d GROUP BY knowledge_block_id)"


def change_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one role in each conversation: what is flushed together."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    found = runs.in_runs(c, "role", "turn", ["conv_id"])
    return found.groupBy("conv_id", "run", "role").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n"))


CHANGE_RUNS = """
WITH c AS (SELECT conv_id, turn, role, CASE WHEN row_number() OVER w = 1 OR role IS DISTINCT FROM lag(role) OVER w THEN 1 ELSE 0 END AS changed FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, CAST(sum(changed) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM c)
SELECT conv_id, run, role, min(turn) AS first_turn, count(*) AS n FROM r GROUP BY conv_id, run, role
"""


def write_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending decisions after a try to write them, which fails for those about purchases."""
    d = decided(spark, sf_dir)
    tried = d.where("seq % 3 != 0").select("seq", F.when(F.col("target_page") == "purchase", F.lit("locked")).alias("error"))
    return D.with_outcome(d, tried).select("seq", "write_status", "error")


WRITE_OUTCOMES = DECIDED + """
SELECT seq, CASE WHEN write_status = 'pending' AND seq % 3 <> 0 THEN CASE WHEN target_page = 'purchase' THEN 'failed' ELSE 'completed' END ELSE write_status END AS write_status,
  CASE WHEN seq % 3 <> 0 AND target_page = 'purchase' THEN 'locked' END AS error FROM d
"""


def edit_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' first turns as edited blocks: reworded ones accepted, some edited by hand twice, some reverted; decisions bind the text late."""
    c = read(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").cast("string").alias("block_id"), F.col("text").alias("original_content"), F.col("conv_id"))
    e = c.withColumns({"reworded_content": F.when(F.col("conv_id") % 4 != 0, F.concat(F.lit("re "), "block_id")), "rewording_complete": F.col("conv_id") % 3 != 0, "current_content": F.col("original_content")})
    e = D.accepted_rewording(e)
    typed = c.where("conv_id % 5 = 0").select("block_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq")).withColumn("text", F.concat(F.lit("typed "), F.col("seq").cast("string")))
    e = D.with_manual_edits(e, typed)
    e = D.reverted(e.where("conv_id % 10 = 0")).unionByName(e.where("conv_id % 10 != 0"))
    asked = c.where("conv_id % 2 = 0").select(F.col("block_id").alias("knowledge_block_id"))
    return D.late_bound(asked, e).select("knowledge_block_id", F.md5("refined_text").alias("text_md5"))


EDIT_STATES = """
SELECT CAST(conv_id AS VARCHAR) AS knowledge_block_id, md5(CASE WHEN conv_id % 10 = 0 THEN text WHEN conv_id % 5 = 0 THEN 'typed 2' WHEN conv_id % 4 <> 0 AND conv_id % 3 <> 0 THEN 're ' || conv_id ELSE text END) AS text_md5
FROM conversations WHERE turn = 0 AND conv_id % 2 = 0
"""


def journal_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day of each decision's block: of several journals the last; unknown ones get the earliest day of all."""
    o = read(spark, sf_dir, "orders").select(F.concat(F.lit("b"), "o_custkey").alias("hybrid_id"), F.to_date("o_orderdate").alias("day"))
    return D.dated(decided(spark, sf_dir), D.journal_dates(o)).select("seq", F.col("day").cast("string").alias("day"))


JOURNAL_FALLBACK = DECIDED + """
, o AS (SELECT 'b' || o_custkey AS id, max(CAST(o_orderdate AS DATE)) AS day FROM orders GROUP BY 1)
SELECT seq, CAST(coalesce(o.day, (SELECT min(day) FROM o)) AS VARCHAR) AS day FROM d LEFT JOIN o ON o.id = d.knowledge_block_id
"""


def target_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of each decision's target, from the last candidate with its id; only decisions of blocks that have candidates."""
    c = read(spark, sf_dir, "conversations").select(F.concat(F.lit("t"), F.col("conv_id") % 5).alias("block_id"), F.concat(F.lit("- "), "text").alias("document"), F.struct("conv_id", "turn").alias("seq"))
    d = decided(spark, sf_dir)
    asked = D.with_candidates(d.withColumn("block_id", F.col("target_block_id")), c)
    return D.with_titles(asked, c).select(d["seq"], F.md5("target_block_title").alias("title_md5"))


TARGET_TITLES = DECIDED + r"""
, c AS (SELECT 't' || (conv_id % 5) AS id, arg_max(text, {'c': conv_id, 't': turn}) AS text FROM conversations GROUP BY 1),
f AS (SELECT id, regexp_replace('- ' || string_split(text, chr(10))[1], '^- ', '') AS f FROM c)
SELECT seq, md5(CASE WHEN length(trim(f)) > 50 THEN substr(trim(f), 1, 47) || '...' ELSE trim(f) END) AS title_md5 FROM d JOIN f ON f.id = d.target_block_id
"""


def page_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled document names a page; the pages' texts, and which are missing."""
    candidates = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page"))
    found = G.with_contents(candidates, read(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.col("html").alias("text")))
    return found.select("page", F.md5("text").alias("digest"), "missing")


PAGE_CONTENTS = """
SELECT l.doc_id AS page, md5(p.html) AS digest, p.html IS NULL AS missing
FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id IS NOT NULL) l LEFT JOIN pages p ON p.page_id = l.doc_id
"""
