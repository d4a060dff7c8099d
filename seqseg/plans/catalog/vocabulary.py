"""Label dictionaries, ids, task text and text cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqseg.functions import text as tx
from seqseg.operators import runs as rn, vocab as vc
from seqseg.operators.ordered import FRAME, KEYS
from seqseg.plans import adapters as ad
from seqseg.plans.catalog._sql import EV, VOCAB, runs_cte, with_

E = "episode_index"


def _names(spark, sf):
    events = ad.table(spark, sf, "events").select(F.lit("events").alias("dataset"), F.col("event_type").alias("name"))
    langs = ad.table(spark, sf, "documents").select(F.lit("documents").alias("dataset"), F.col("lang").alias("name"))
    parts = ad.table(spark, sf, "part").select(F.lit("part").alias("dataset"), F.lower("p_type").alias("name"))
    return vc.union_of([events, langs, parts])


def union_vocab(spark, sf):
    return vc.union_vocab(_names(spark, sf))


def _local(spark, sf):
    """Each dataset numbers its own names by falling frequency."""
    from seqseg.operators.ordered import rank_rows

    counted = _names(spark, sf).groupBy("dataset", "name").agg(F.count(F.lit(1)).alias("n"))
    ranked = rank_rows(counted, ["dataset"], [F.desc("n"), "name"], [-F.col("n")], out="action_text_id")
    return ranked.where("name NOT LIKE '%e%'").select("dataset", "action_text_id", "name")


def remap_ids(spark, sf):
    """Local ids of all rows to union ids; part sizes act as ids without a name."""
    part = ad.table(spark, sf, "part").select(
        F.lit("part").alias("dataset"), F.col("p_partkey").alias("row_id"),
        F.col("p_size").cast("long").alias("action_text_id"),
    )
    docs = ad.table(spark, sf, "documents").select(
        F.lit("documents").alias("dataset"), F.col("doc_id").alias("row_id"),
        F.pmod("n_chars", F.lit(5)).cast("long").alias("action_text_id"),
    )
    mapped = vc.to_union_ids(part.unionByName(docs), _local(spark, sf), union_vocab(spark, sf))
    return mapped.select("dataset", "row_id", "action_text_id", "union_id")


def _phrases(spark, sf):
    """Segments whose text is a part name or order priority in mixed spelling."""
    orders = ad.table(spark, sf, "orders")
    spelled = F.when(F.col("o_orderstatus") == "F", F.lower("o_orderpriority")).otherwise(
        F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" "))
    )
    text = (
        F.when(F.col("o_totalprice") < 20000, F.lit("  "))
        .when(F.col("o_totalprice") < 40000, F.lit("Background"))
        .otherwise(spelled)
    )
    return orders.select(
        F.lit("orders").alias("dataset"),
        F.col("o_custkey").alias(E),
        F.col("o_orderkey").alias("segment_index"),
        F.lit(0).alias("start_frame"),
        F.lit(4).alias("end_frame"),
        text.alias("text"),
    )


def open_vocab(spark, sf):
    return vc.first_seen(_phrases(spark, sf))


def open_vocab_ids(spark, sf):
    phrases = _phrases(spark, sf)
    ids = vc.apply_first_seen(phrases, vc.first_seen(phrases))
    return ids.select(E, "segment_index", "action_text_id")


def strict_ids(spark, sf):
    vocab = vc.union_vocab(ad.table(spark, sf, "events"), "event_type")
    return vc.strict_ids(ad.ev_frames(spark, sf), vocab).select(E, FRAME, "label", "action_text_id")


def class_names(spark, sf):
    """Names with gaps: every event type but one."""
    vocab = vc.union_vocab(ad.table(spark, sf, "events"), "event_type")
    high = ad.table(spark, sf, "events").where("event_type <> 'signup'").select(F.col("event_type").alias("name"))
    return vc.class_names(vocab.join(high.distinct(), "name", "left_semi"), 6)


def background_ids(spark, sf):
    return vc.background_ids(union_vocab(spark, sf))


def task_text(spark, sf):
    """Task field in all its forms: list of names, list of ids, id, plain name, nothing."""
    from seqseg.plans.tasks import resolve_task_text

    customers = ad.table(spark, sf, "customer")
    tasks_json = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit('["'), F.lower("c_name"), F.lit('"]')))
        .when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("["), F.col("c_nationkey").cast("string"), F.lit("]")))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("[999]"))
        .when(F.col("c_mktsegment") == "AUTOMOBILE", F.lit("[]"))
    )
    episodes = customers.select(
        F.lit("customer").alias("dataset"),
        F.col("c_custkey").alias(E),
        tasks_json.alias("tasks"),
        F.when(F.col("c_acctbal") > 3000, F.col("c_nationkey").cast("long")).alias("task_index"),
        F.when(F.col("c_acctbal") < 0, F.col("c_name")).alias("task"),
    )
    tasks = ad.table(spark, sf, "nation").select(
        F.lit("customer").alias("dataset"),
        F.col("n_nationkey").cast("long").alias("task_index"),
        F.col("n_name").alias("task"),
    )
    return resolve_task_text(episodes, tasks).select(E, "task_text")


def clean_text(spark, sf):
    """Whole texts with markers in front, cleaned."""
    documents = ad.table(spark, sf, "documents")
    marked = (
        F.when(F.col("lang") == "en", F.concat(F.lit(" Assistant\n assistant: "), "text"))
        .when(F.col("lang") == "fr", F.concat(F.lit("ASSISTANT: assistant:assistant:"), "text", F.lit("<|im_end|> ")))
        .when(F.col("lang") == "de", F.lit(" <|endoftext|>"))
        .otherwise(F.col("text"))
    )
    cleaned = documents.select("doc_id", tx.clean_label(marked).alias("text"))
    return cleaned.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n"))


def chat_examples(spark, sf):
    """One example per assistant turn: the turn before is the task."""
    from seqseg.operators.ordered import neighbours

    turns = neighbours(
        ad.cv_turns(spark, sf), {"task_text": lambda w: F.lag("text").over(w)}, before=1
    )
    target = F.when(F.col("role") == "assistant", tx.clean_label(F.col("text")))
    chat = tx.segment_chat(F.coalesce("task_text", F.lit("")), target)
    messages = turns.select(E, FRAME, F.posexplode(chat).alias("pos", "m"))
    parts = messages.select(E, FRAME, "pos", F.col("m.role").alias("role"), F.posexplode("m.content").alias("item", "c"))
    return parts.select(
        E, FRAME, F.col("pos").cast("long").alias("pos"), F.col("item").cast("long").alias("item"),
        "role", F.col("c.type").alias("type"), F.md5("c.text").alias("text_md5"),
    )


def record_ids(spark, sf):
    found = rn.runs(ad.ev_frames(spark, sf))
    return found.select(
        tx.segment_id(F.col("dataset"), F.col(E), F.lit("top"), F.col("start_frame"), F.col("end_frame")).alias("segment_id"),
        tx.episode_id(F.col("dataset"), F.col(E)).alias("episode_id"),
    )


QUERIES = {
    "union_vocab": union_vocab,
    "remap_ids": remap_ids,
    "open_vocab": open_vocab,
    "open_vocab_ids": open_vocab_ids,
    "strict_ids": strict_ids,
    "class_names": class_names,
    "background_ids": background_ids,
    "task_text": task_text,
    "clean_text": clean_text,
    "chat_examples": chat_examples,
    "record_ids": record_ids,
}

_NAMES = """names AS (
  SELECT 'events' AS dataset, event_type AS name FROM events
  UNION ALL SELECT 'documents', lang FROM documents
  UNION ALL SELECT 'part', lower(p_type) FROM part)"""
_UNION = """uni AS (
  SELECT 'background' AS name, 0::BIGINT AS action_text_id
  UNION ALL SELECT name, row_number() OVER (ORDER BY name)
  FROM (SELECT DISTINCT name FROM names WHERE name <> 'background'))"""
_PHRASES = """phrases AS (
  SELECT o_custkey AS e, o_orderkey AS s,
    trim(CASE WHEN o_totalprice < 20000 THEN '' WHEN o_totalprice < 40000 THEN 'Background'
         WHEN o_orderstatus = 'F' THEN lower(o_orderpriority) ELSE o_orderpriority END) AS t
  FROM orders),
open AS (
  SELECT 'background' AS key, 'background' AS name, 0::BIGINT AS action_text_id
  UNION ALL
  SELECT key, name, row_number() OVER (ORDER BY e, s) FROM (
    SELECT lower(t) AS key, t AS name, e, s FROM phrases WHERE t <> '' AND lower(t) <> 'background'
    QUALIFY row_number() OVER (PARTITION BY lower(t) ORDER BY e, s) = 1))"""
_CHAT_Q = "'Task: ' || task || '. What subtask is happening in the video segment? Answer with a short verb phrase.'"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)"


def _clean(expression: str) -> str:
    """The same cleaning as nested SQL."""
    t = f"trim({expression}, {_WS})"
    t = f"trim(CASE WHEN lower({t})[1:10] = 'assistant' || chr(10) THEN ({t})[11:] ELSE {t} END, {_WS})"
    return t


ORACLES = {
    "union_vocab": with_(_NAMES, _UNION) + "SELECT name, action_text_id FROM uni",
    "remap_ids": with_(
        _NAMES,
        _UNION,
        """loc AS (SELECT dataset, name, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, name) - 1 AS id, n
          FROM (SELECT dataset, name, count(*) AS n FROM names GROUP BY 1, 2))""",
        """rows_ AS (
          SELECT 'part' AS dataset, p_partkey AS row_id, p_size::BIGINT AS action_text_id FROM part
          UNION ALL SELECT 'documents', doc_id, (n_chars % 5)::BIGINT FROM documents)""",
    )
    + """SELECT r.dataset, r.row_id, r.action_text_id, coalesce(u.action_text_id, 0)::BIGINT AS union_id
FROM rows_ r LEFT JOIN loc l ON l.dataset = r.dataset AND l.id = r.action_text_id AND l.name NOT LIKE '%e%'
LEFT JOIN uni u ON u.name = l.name""",
    "open_vocab": with_(_PHRASES) + "SELECT key, name, action_text_id FROM open",
    "open_vocab_ids": with_(_PHRASES)
    + """SELECT p.e AS episode_index, p.s AS segment_index, coalesce(o.action_text_id, 0)::BIGINT AS action_text_id
FROM phrases p LEFT JOIN open o ON o.key = lower(p.t)""",
    "strict_ids": with_(EV, VOCAB)
    + """SELECT e.episode_index, e.frame_index, e.label, v.id AS action_text_id FROM ev e JOIN vocab v ON v.name = e.label""",
    "class_names": with_(VOCAB)
    + """SELECT i::BIGINT AS action_text_id, coalesce(v.name, i::VARCHAR) AS name
FROM (SELECT unnest(range(6)) AS i) LEFT JOIN (
  SELECT * FROM vocab v WHERE EXISTS (SELECT 1 FROM events e WHERE e.event_type = v.name AND e.event_type <> 'signup')) v ON v.id = i""",
    "background_ids": with_(VOCAB) + "SELECT id AS action_text_id FROM vocab WHERE name = 'background'",
    "task_text": """SELECT c.c_custkey AS episode_index,
  CASE WHEN c_mktsegment = 'BUILDING' THEN lower(c_name)
       WHEN c_mktsegment = 'MACHINERY' THEN n.n_name
       WHEN c_acctbal > 3000 THEN n.n_name
       WHEN c_acctbal < 0 THEN c_name ELSE '' END AS task_text
FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey""",
    "clean_text": f"""WITH d AS (SELECT doc_id, lang, CASE WHEN lang = 'de' THEN '' ELSE text END AS text FROM documents),
s AS (SELECT doc_id, replace(replace(replace(
    CASE WHEN lang = 'fr' THEN 'assistant:' || text ELSE trim(text, {_WS}) END,
    '<|im_end|>', ''), '<|endoftext|>', ''), '<|im_start|>', '') AS t FROM d),
c AS (SELECT doc_id, coalesce(nullif(trim(t, {_WS}), ''), 'unknown') AS t FROM s)
SELECT doc_id, md5(t) AS text_md5, length(t)::BIGINT AS n FROM c""",
    "chat_examples": f"""WITH t AS (
  SELECT conv_id AS episode_index, turn::BIGINT AS frame_index, role AS who, text,
    coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS task FROM conversations),
m AS (
  SELECT episode_index, frame_index, 0 AS pos, 0 AS item, 'system' AS role, 'text' AS type,
    {_quote(tx.SYSTEM_PROMPT)} AS x FROM t
  UNION ALL SELECT episode_index, frame_index, 1, 0, 'user', 'video', '<video>' FROM t
  UNION ALL SELECT episode_index, frame_index, 1, 1, 'user', 'text', {_CHAT_Q} FROM t
  UNION ALL SELECT episode_index, frame_index, 2, 0, 'assistant', 'text',
    coalesce(nullif(trim(text, {_WS}), ''), 'unknown') FROM t WHERE who = 'assistant')
SELECT episode_index, frame_index, pos::BIGINT AS pos, item::BIGINT AS item, role, type, md5(x) AS text_md5 FROM m""",
    "record_ids": with_(EV, runs_cte("ev"))
    + """SELECT printf('events__ep%06d__top__%06d_%06d', episode_index, start_frame, end_frame) AS segment_id,
  printf('events__episode_%06d', episode_index) AS episode_id FROM runs""",
}
