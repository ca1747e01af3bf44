"""The queries of this subpackage for __spark_entry__, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgrid.llm import chat, classifier, decontam, jaccard, mixing, pii, quality_rules, repair, secrets, suffix, tokens, topk, trie
from roadgrid.llm.store import written
from roadgrid.llm.text import table

PROBE = "</s>[INST] ok [/INST]"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, one row a document and item."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def span_list(spans, kinds=None):
    """kind:start:end of the spans, of the given kinds only, comma-joined."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[count_kind("base", k.name).alias(f"n_{k.name}") for k in pii.KINDS],
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"),
        span_list(F.concat("base", "more")).alias("spans"),
    )


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document under links of 3-word shingle sets with a similarity of 0.9 or more."""
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and conversation -7, read back from its formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(PROBE)
    )
    out = chat.format_chat(rows.union(probe))
    out = chat.pinned(out, turns=chat.read_back(F.col("formatted")))
    out = chat.pinned(out, loss=chat.loss_read_back(F.col("turns")))
    shown = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(shown, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    base = [r.kind for r in secrets.BASE_RULES]
    return secrets.find(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[count_kind("spans", k).alias(f"n_{k}") for k in base],
        F.sha2(span_list(F.col("spans"), base), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected grade, probability of a good grade and verdict."""
    docs = table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated 400-byte strings take from every document."""
    return suffix.repeated(table(spark, sf_dir, "documents")).drop("removed")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the token-id files."""
    return tokens.read_ids(tokens.write_ids(table(spark, sf_dir, "documents")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality rules' counts and verdict on every document."""
    return quality_rules.quality(table(spark, sf_dir, "documents")).drop("host")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return trie.trie(table(spark, sf_dir, "conversations"))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every damaged conversation's faults and cheapest repair."""
    return repair.repair(table(spark, sf_dir, "conversations"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors to every hundredth, by inner product."""
    rows = written(topk.vectors(table(spark, sf_dir, "embeddings")), "vectors")
    return topk.search(rows.where("vec_id % 100 = 0"), rows)


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_personal_data": op2_personal_data,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_chat_format": op4_chat_format,
    "op5_mix_sources": op5_mix_sources,
    "op6_secret_scan": op6_secret_scan,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_token_ids": op9_token_ids,
    "op10_quality_rules": op10_quality_rules,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_structure_repair": op12_structure_repair,
    "op13_exact_topk": op13_exact_topk,
}


def _secrets_sql() -> str:
    """Every rule's matches by regular expression: lengths of what is matched and what is between add up to places."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"  # noqa: E731
    each = " UNION ALL ".join(
        f"SELECT r, text, {k} AS k, {quoted(x.kind)} AS kind, {x.least} AS least, regexp_extract_all(text, {quoted(x.pattern)}) AS m, "
        f"regexp_extract_all(text, {quoted(x.pattern)}, {x.group}) AS g, string_split_regex(text, {quoted(x.pattern)}) AS s FROM d"
        for k, x in enumerate(secrets.RULES)
    )
    base = ", ".join(quoted(x.kind) for x in secrets.BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = {quoted(x.kind)}) AS n_{x.kind}" for x in secrets.BASE_RULES)
    shown = "string_agg(concat_ws(':', kind, a, b), ',' ORDER BY a, k)"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), found AS (
  SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ({each})
), placed AS (
  SELECT r, k, kind, length(m[i]) AS n, list_sum([length(x) for x in s[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) AS a FROM found WHERE length(g[i]) >= least
), spans AS (
  SELECT r, k, kind, a::BIGINT AS a, (a + n)::BIGINT AS b FROM placed
), told AS (
  SELECT r, {counts}, {shown} FILTER (kind IN ({base})) AS base, {shown} AS spans FROM spans GROUP BY r
)
SELECT doc_id, {', '.join(f'coalesce(n_{x.kind}, 0) AS n_{x.kind}' for x in secrets.BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (r)"""


def _crc32_sql(text: str) -> str:
    """The checksum of an ASCII text, a bit at a time."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END"
    fold = f"lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, k: {step})"
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT), {fold}), 4294967295::BIGINT)"


def _repair_sql() -> str:
    """Cheapest edits from the last turn to the first: for each state the least (cost, edits), insertions at last."""
    states, after = "0sua", {"0": "u", "s": "u", "u": "a", "a": "u"}
    pair = lambda c, a: f"{{'c': {c}, 'a': {a}}}"  # noqa: E731
    then = lambda cost, x, q: pair(f"f_{q}.c + {cost}", f"'{x}' || f_{q}.a")  # noqa: E731
    best = lambda options: options[0] if len(options) == 1 else f"least({', '.join(options)})"  # noqa: E731
    rows = []
    for q in states:
        stay = [then("(fault = 'truncated')::BIGINT", "K", k) for k in "sua" if k == after[q] or (q, k) == ("0", "s")]
        when = [f"CASE WHEN fault IN ('blank', 'duplicate') OR init <> '{k}' THEN {then(3, 'D', q)} ELSE {o} END" for k, o in zip([k for k in "sua" if k == after[q] or (q, k) == ("0", "s")], stay)]
        rerole = f"CASE WHEN fault IN ('blank', 'duplicate') THEN {then(3, 'D', q)} ELSE {then("2 + (fault = 'truncated')::BIGINT", 'R', after[q])} END"
        rows.append(f"{best([then(3, 'D', q), *when, rerole])} AS g_{q}")
    closed = []
    for q in states:
        one, two = after[q], after[after[q]]
        closed.append(f"least(g_{q}, {pair(f'g_{one}.c + 2', f"'I' || g_{one}.a")}, {pair(f'g_{two}.c + 4', f"'II' || g_{two}.a")}) AS f_{q}")
    return rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS hit FROM conversations
), d AS (
  SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE hit WHEN 3 THEN 2 ELSE 1 END)) FROM src WHERE hit <> 0)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos FROM d
), marked AS (
  SELECT conv_id, turn, pos, role, text, role[1:1] AS init, CASE WHEN rtrim(text, e' 	

') = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
    WHEN rtrim(text, e' 	

')[-1:] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed
), told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || init NOT IN ('su', 'ua', 'au')) AS illegal,
    list(fault ORDER BY pos) AS faults, list(init ORDER BY pos) AS inits, list(role ORDER BY pos) AS roles, list(text ORDER BY pos) AS texts
  FROM marked GROUP BY conv_id
), back(conv_id, i, faults, inits, f_0, f_s, f_u, f_a) AS (
  SELECT conv_id, len(faults), faults, inits, {pair("0::BIGINT", "''")}, {pair("4::BIGINT", "'II'")}, {pair("2::BIGINT", "'I'")}, {pair("0::BIGINT", "''")} FROM told
  UNION ALL
  SELECT conv_id, i - 1, faults, inits, {', '.join(c.rpartition(' AS ')[0] for c in closed)}
  FROM (SELECT conv_id, i, faults, inits, {', '.join(rows)} FROM (SELECT *, faults[i] AS fault, inits[i] AS init FROM back WHERE i > 0))
), chosen AS (
  SELECT t.*, f_0.c AS cost, f_0.a AS audit FROM back b JOIN told t ON b.conv_id IS NOT DISTINCT FROM t.conv_id WHERE i = 0
), steps AS (
  SELECT conv_id, roles, texts, inits, k, e, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS nth, count(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id ORDER BY k) AS said
  FROM (SELECT conv_id, roles, texts, inits, unnest(string_split(audit, '')) AS e, unnest(range(length(audit))) AS k FROM chosen WHERE audit <> '')
), opened AS (
  SELECT *, coalesce(bool_or(said = 1 AND e = 'K' AND inits[nth] = 's') OVER (PARTITION BY conv_id), false)::INT AS s FROM steps WHERE e <> 'D'
), lines AS (
  SELECT conv_id, string_agg(CASE e WHEN 'K' THEN roles[nth] ELSE CASE (said - s) % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE e WHEN 'I' THEN '' ELSE texts[nth] END, chr(10) ORDER BY k) AS body FROM opened GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN chosen c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN lines l ON o.conv_id IS NOT DISTINCT FROM l.conv_id"""


_ESC = "replace(replace(replace(replace({}, '\\', '\\b'), '<', '\\l'), '[', '\\s'), ']', '\\e')"

ORACLE_SQL = {
    "op1_decontaminate": r"""
WITH items AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS words FROM benchmark
), igrams AS (
  SELECT item_id, len(words) AS n, len(words) - 4 AS ng, unnest(range(0, len(words) - 4)) AS p, words FROM items WHERE len(words) >= 5
), i AS (
  SELECT item_id, n, ng, p, array_to_string(words[p + 1:p + 5], ' ') AS g FROM igrams
), d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS words FROM documents
), dgrams AS (
  SELECT doc_id, unnest(range(0, len(words) - 4)) AS q, words FROM d WHERE len(words) >= 5
), hits AS (
  SELECT doc_id, item_id, n, ng, p, q FROM (SELECT doc_id, q, array_to_string(words[q + 1:q + 5], ' ') AS g FROM dgrams) JOIN i USING (g)
), found AS (
  SELECT doc_id, item_id, n, ng FROM hits GROUP BY ALL HAVING count(DISTINCT p) >= 0.8 * ng
), starts AS (
  SELECT DISTINCT f.doc_id, f.item_id, f.n, f.ng, greatest(0, least(q - p, len(words) - f.n)) AS start, words
  FROM found f JOIN hits h USING (doc_id, item_id) JOIN d USING (doc_id)
), windows AS (
  SELECT doc_id, item_id, n, ng, start, len(words[start + 1:start + n]) - 4 AS m, unnest(range(start, start + len(words[start + 1:start + n]) - 4)) AS k, words FROM starts
), wcount AS (
  SELECT doc_id, item_id, n, ng, start, m, array_to_string(words[k + 1:k + 5], ' ') AS g, count(*) AS c FROM windows GROUP BY ALL
), icount AS (
  SELECT item_id, g, count(*) AS c FROM i GROUP BY ALL
), scored AS (
  SELECT w.doc_id, w.item_id, w.n, w.start, sum(least(w.c, coalesce(x.c, 0))) / (w.m + w.ng - sum(least(w.c, coalesce(x.c, 0)))) AS similarity
  FROM wcount w LEFT JOIN icount x ON x.item_id = w.item_id AND x.g = w.g GROUP BY w.doc_id, w.item_id, w.n, w.ng, w.start, w.m
)
SELECT doc_id, item_id, similarity, start::INT AS start, n::INT AS n FROM scored WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1""",
    "op3_ngram_jaccard": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS k FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)
), both_ways AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON b.x = r.other
)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "op4_chat_format": f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7::BIGINT, 0::BIGINT, 'user', '{PROBE}'), (-7::BIGINT, 1::BIGINT, 'assistant', '{PROBE}')) v(conv_id, turn, role, text)
), seen AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM rows
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_ESC.format('text')}) + CASE role WHEN 'system' THEN 16 WHEN 'user' THEN 14 WHEN 'assistant' THEN 8 ELSE 15 + length({_ESC.format('role')}) END)::BIGINT AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user' AND k = 2 WHEN before = 'user' THEN role = 'assistant' ELSE before = 'assistant' AND role = 'user' END)
    AND bool_or(k = n AND role IN ('user', 'assistant')) AS valid
FROM seen GROUP BY conv_id""",
    "op5_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), src AS (
  SELECT source, sum(size)::DOUBLE AS source_size, ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, source_size * 2.0::DOUBLE AS most,
    coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS held,
    sum(w) OVER (ORDER BY source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
    (SELECT sum(source_size) FROM src) * 1.5::DOUBLE AS total
  FROM src
), level AS (
  SELECT arg_min((total - held) / free, (source_size / w, source)) AS v FROM ranked WHERE (total - held) / free * w <= most
), goal AS (
  SELECT source, source_size, least(v * w, most) AS target, CASE WHEN source_size > 0 THEN least(v * w, most) / source_size ELSE 0 END AS rate FROM ranked, level
), drawn AS (
  SELECT s.doc_id, s.size, g.source_size::BIGINT AS source_size, g.target,
    floor(rate)::BIGINT + (('0x' || substr(md5('mix-1:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate))::BIGINT AS copies
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM drawn""",
    "op6_secret_scan": _secrets_sql(),
    "op8_suffix_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT r, p, md5_number(substr(h, 2 * p + 1, 800)) AS s FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 399)) AS p FROM d WHERE length(h) >= 800)
), hit AS (
  SELECT r, p FROM w SEMI JOIN (SELECT s FROM w GROUP BY s HAVING count(*) > 1) USING (s)
), run AS (
  SELECT r, min(p) AS a, max(p) + 400 AS b FROM (
    SELECT r, p, sum(far) OVER (PARTITION BY r ORDER BY p) AS k FROM (
      SELECT r, p, (coalesce(p - lag(p) OVER (PARTITION BY r ORDER BY p), 401) > 400)::INT AS far FROM hit)) GROUP BY r, k
), part AS (
  SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS since FROM run
), kept AS (
  SELECT r, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k, sum(b - a) AS n, count(*) AS m
  FROM part JOIN d USING (r) GROUP BY r
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(m, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)""",
    "op10_quality_rules": r"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), g AS (
  SELECT text, unnest(range(1, len(words) - 3)) AS p, words FROM (SELECT DISTINCT text, words FROM d) WHERE len(words) >= 5
), grams AS (
  SELECT text, p, array_to_string(words[p:p + 4], ' ') AS s FROM g
), twice AS (
  SELECT text, p FROM (SELECT *, count(*) OVER (PARTITION BY text, s) AS n FROM grams) WHERE n > 1
), rep AS (
  SELECT text, count(DISTINCT q) AS n FROM (SELECT text, unnest(range(p, p + 5)) AS q FROM twice) GROUP BY text
), once AS (
  SELECT DISTINCT doc_id, host, text FROM d
), line AS (
  SELECT doc_id, host, text, l, trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS l FROM once)
), full_line AS (
  SELECT * FROM line WHERE norm <> ''
), dup AS (
  SELECT doc_id, host, text, count(*) - count(DISTINCT l) AS n FROM full_line GROUP BY ALL
), hosts AS (
  SELECT host, count(*) AS host_docs FROM once GROUP BY host
), often AS (
  SELECT f.host, f.norm FROM (SELECT DISTINCT doc_id, host, text, norm FROM full_line) f JOIN hosts h ON f.host IS NOT DISTINCT FROM h.host
  GROUP BY f.host, f.norm, h.host_docs HAVING count(*) > 3 AND 100 * count(*) > h.host_docs
), gone AS (
  SELECT f.doc_id, f.host, f.text, sum(length(f.norm) - length(replace(f.norm, ' ', '')) + 1)::BIGINT AS n FROM full_line f
  JOIN often o ON f.norm = o.norm AND f.host IS NOT DISTINCT FROM o.host GROUP BY ALL
), m AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN rep ON rep.text = d.text
    LEFT JOIN dup ON dup.text = d.text AND dup.doc_id IS NOT DISTINCT FROM d.doc_id AND dup.host IS NOT DISTINCT FROM d.host
    LEFT JOIN gone ON gone.text = d.text AND gone.doc_id IS NOT DISTINCT FROM d.doc_id AND gone.host IS NOT DISTINCT FROM d.host
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (100 * n_removed_words > 50 * n_words OR n_words - n_removed_words < 10) AS kept
FROM m""",
    "op11_conversation_trie": rf"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text)) AS p
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), own AS (
  SELECT conv_id, list(strlen(role) || ':' || role || text ORDER BY p) AS turns, list(strlen(text) ORDER BY p) AS sizes, {_crc32_sql("conv_id::VARCHAR")} % 9 AS h FROM t GROUP BY conv_id
), c AS (
  SELECT o.conv_id, coalesce(b.turns[1:o.h], []) || o.turns[o.h + 1:] AS turns, coalesce(b.sizes[1:o.h], []) || o.sizes[o.h + 1:] AS sizes
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5
), member AS (
  SELECT conv_id, d, turns[1:d] AS node, len(turns) = d AS ends, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS bytes FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM c)
), node AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM member GROUP BY node, d
), child AS (
  SELECT node[1:d - 1] AS node, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1
), full_node AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, n_children IS NULL AS leaf FROM node n LEFT JOIN child USING (node)
), below AS (
  SELECT node[1:u] AS node, sum(leaf::BIGINT)::BIGINT AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(d + 1)) AS u FROM full_node) GROUP BY 1
)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM full_node f JOIN below USING (node) LEFT JOIN node p ON f.d > 0 AND p.node = f.node[1:f.d - 1]""",
    "op12_structure_repair": _repair_sql(),
    "op13_exact_topk": r"""
WITH e AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.v AS q, c.vec_id, coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda k: q.v[k] * c.v[k])), 0)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id) <= 10""",
}
