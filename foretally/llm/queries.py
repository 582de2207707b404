"""The registered queries of the corpus operators, and the SQL they are checked with."""

import public_tokenizers
from pyspark.sql import functions as F

from foretally.llm import (
    arrow_files, chat, conversations, decontamination, jaccard_join, language_id, licenses, masked_lm, packing, quality, sharding,
    token_counts, whitening)
from foretally.session import durable
from foretally.sources.tables import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SHARDS = 16


def op1_best_fit_packing(spark, sf_dir):
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_jaccard_join(spark, sf_dir):
    joined = jaccard_join.jaccard_join(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return joined.select("row.doc_id", "class_id", "n_links")


def op3_arrow_output(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    read = arrow_files.read_documents(arrow_files.write_arrow(docs, BYTE_BPE), dict(docs.dtypes)["doc_id"])
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_chat_role_repair(spark, sf_dir):
    return chat.repair(table(spark, sf_dir, "conversations"))


def op5_license_scan(spark, sf_dir):
    found = licenses.scan(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("row.doc_id", "license", "n_found", "n_shingles", "window_start")


def op5_license_names(spark, sf_dir):
    """The licenses told apart; op5_license_scan and its SQL report every notice that holds enough shingles.
    Documents without one have a row of nulls."""
    docs = table(spark, sf_dir, "documents")
    found = durable(licenses.scan(docs, carry=["doc_id"], phrases=licenses.PHRASES).select("row.doc_id", "license", "n_found", "n_shingles", "window_start"))
    ids = found.select(F.col("doc_id").alias("with")).distinct()
    without = docs.select("doc_id").join(ids, F.col("doc_id").eqNullSafe(F.col("with")), "left_anti")
    return found.unionByName(without, allowMissingColumns=True)


def op6_quality_rules(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_masked_scoring(spark, sf_dir):
    return masked_lm.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op8_positional_decontamination(spark, sf_dir):
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op9_jump_sharding(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.place_rows(rows, "doc_id", SHARDS, ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE, limit=512)


def op11_jacobi_davidson_whitening(spark, sf_dir):
    made = whitening.whiten(table(spark, sf_dir, "embeddings"), "embedding", components=4, carry=["vec_id"])
    return made.select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual")


def op12_conversation_structure(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations")
    return conversations.repair_structure(conversations.damaged(talks), every=talks)


def op13_compression_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3
    model = language_id.learn(docs.where(fold != 1))
    found = language_id.identify(docs.withColumn("held_out", fold == 1), model, carry=["doc_id", "held_out"])
    return found.select("row.doc_id", "row.held_out", F.col("guess").alias("lang_pred"), "score", "narrow")


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_jaccard_join, op3_arrow_output, op4_chat_role_repair, op5_license_scan,
    op6_quality_rules, op7_masked_scoring, op8_positional_decontamination, op9_jump_sharding, op10_token_counts,
    op11_jacobi_davidson_whitening, op12_conversation_structure, op13_compression_language, op5_license_names)}

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
CRC_TABLE = """entries AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)) AS t)"""


def crc_of(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, with the table of ``CRC_TABLE`` in reach."""
    return f"""xor(list_reduce(regexp_extract_all(hex({text}), '..'), lambda c, h: xor(c // 256, t[(xor(c % 256,
      (instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1) + 1)::BIGINT]), 4294967295::BIGINT), 4294967295)"""


WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"



def chat_sql() -> str:
    """The repair as two recursive walks: cheapest costs forward, the chosen states backward."""
    names, states = list(chat.ROLES), range(chat.STATES)
    header = [chat.OPEN.format(name) for name in names]
    between = [[() if s == g else chat.BETWEEN.get((s, g), ()) for g in range(3)] for s in states]
    inserted = [[",".join(names[r] for r in put) for put in row] for row in between]
    opened = [["".join(header[r] + chat.CLOSE for r in put) for put in row] for row in between]
    closing = [",".join(names[r] for r in chat.ENDING[s]) for s in states]
    closed = ["".join(header[r] + chat.CLOSE for r in chat.ENDING[s]) for s in states]
    ending = [chat.INSERT * len(chat.ENDING[s]) for s in states]
    never = chat.NEVER
    return f"""
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, coalesce(nullif(list_position({names}, lower(trim(role))), 0), 4) AS f,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, coalesce(text, '')) AS pos FROM conversations),
sizes AS (SELECT conv_id, max(pos) AS n FROM turns GROUP BY conv_id),
ahead AS (
  SELECT conv_id, 0::BIGINT AS pos, [{never}, {never}, {never}, 0]::BIGINT[] AS best FROM sizes
  UNION ALL
  SELECT t.conv_id, t.pos, list_concat([list_min([best[s] + ({chat.STEP.tolist()})[f][s][g] FOR s IN range(1, 5)]) FOR g IN range(1, 4)], [{never}::BIGINT])
  FROM ahead JOIN turns t ON t.conv_id = ahead.conv_id AND t.pos = ahead.pos + 1),
walk AS (
  SELECT conv_id, pos, list_position([best[s] + ({ending})[s] FOR s IN range(1, 5)], list_min([best[s] + ({ending})[s] FOR s IN range(1, 5)])) AS g
  FROM ahead JOIN sizes USING (conv_id) WHERE pos = n
  UNION ALL
  SELECT w.conv_id, w.pos - 1, list_position([b.best[s] + ({chat.STEP.tolist()})[f][s][w.g] = a.best[w.g] FOR s IN range(1, 5)], true)
  FROM walk w JOIN turns t ON t.conv_id = w.conv_id AND t.pos = w.pos JOIN ahead a ON a.conv_id = w.conv_id AND a.pos = w.pos
    JOIN ahead b ON b.conv_id = w.conv_id AND b.pos = w.pos - 1 WHERE w.pos > 0),
chosen AS (
  SELECT t.*, n, x.g AS s, y.g AS g, x.g = y.g AS merged FROM turns t JOIN sizes USING (conv_id)
    JOIN walk x ON x.conv_id = t.conv_id AND x.pos = t.pos - 1 JOIN walk y ON y.conv_id = t.conv_id AND y.pos = t.pos)
SELECT conv_id, pos - 1 AS position, turn, role, ({names})[g] AS new_role,
  CASE WHEN f = g THEN CASE WHEN merged THEN 'merge' ELSE 'keep' END WHEN merged THEN 'relabel and merge' ELSE 'relabel' END AS action,
  ({inserted})[s][g] AS inserted, CASE WHEN pos = n THEN ({closing})[g] ELSE '' END AS closing,
  CASE WHEN merged THEN {chat.MERGE} ELSE {chat.INSERT} * ({[[len(put) for put in row] for row in between]})[s][g] END
    + CASE WHEN f = g THEN 0 ELSE {chat.RELABEL} END + CASE WHEN pos = n THEN ({ending})[g] ELSE 0 END AS cost,
  CASE WHEN merged THEN {quoted(chat.JOINT)} || text ELSE CASE WHEN s = 4 THEN '' ELSE {quoted(chat.CLOSE)} END || {quoted(opened)}[s][g] || {quoted(header)}[g] || text END
    || CASE WHEN pos = n THEN {quoted(chat.CLOSE)} || {quoted(closed)}[g] ELSE '' END AS piece
FROM chosen"""


def structure_sql() -> str:
    """Damage, faults, the cheapest edits from the end, and a walk along them."""
    def least(options):
        return "list_min([" + ", ".join(options) + "])"

    def option(base, state, cost, edit):
        return f"{{'c': {base}[{state + 1}].c + {cost}, 'a': '{edit}' || {base}[{state + 1}].a}}"

    follow, never = conversations.NEXT, 1 << 40
    plain = [least([option("b", s, conversations.DELETE, "D"),
                    f"{{'c': b[{follow[s] + 1}].c + CASE WHEN gone THEN {never} ELSE {conversations.REROLE} + extra END, 'a': 'R' || b[{follow[s] + 1}].a}}"]
                   + [f"{{'c': b[{to + 1}].c + CASE WHEN gone OR ini <> '{letter}' THEN {never} ELSE extra END, 'a': 'K' || b[{to + 1}].a}}"
                      for (at, letter), to in conversations.KEPT.items() if at == s]) for s in range(4)]
    insert = [[f"x[{s + 1}]", option("p", follow[s], conversations.INSERT, "I")] for s in range(4)]
    ending = ", ".join(f"{{'c': {conversations.INSERT * len(c)}::BIGINT, 'a': '{c}'}}" for c in conversations.CLASSES.closing)
    return f"""
WITH RECURSIVE keyed AS (
  SELECT row_number() OVER () AS rid, coalesce(conv_id::VARCHAR, ' ') AS cid, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
{CRC_TABLE},
cases AS (SELECT rid, {crc_of("k")} % 20 AS c FROM keyed, entries),
damaged AS (
  SELECT cid, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role, CASE c WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE c WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM keyed JOIN cases USING (rid))),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text) AS pos,
    substr(role, 1, 1) AS ini, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
judged AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY pos) > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(ini) OVER (PARTITION BY cid ORDER BY pos) || ini AS pair FROM placed),
turns AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN {conversations.TRUNCATED} ELSE 0 END AS extra FROM judged),
sizes AS (SELECT cid, count(*) AS n FROM turns GROUP BY cid),
ahead AS (
  SELECT cid, n + 1 AS pos, [{ending}] AS b FROM sizes
  UNION ALL
  SELECT cid, pos, [{", ".join(least(i) for i in insert)}] AS b
  FROM (SELECT cid, pos, x, [{", ".join(least([f"x[{s + 1}]", option("x", follow[s], conversations.INSERT, "I")]) for s in range(4))}] AS p
    FROM (SELECT t.cid, t.pos, [{", ".join(plain)}] AS x FROM ahead JOIN turns t ON t.cid = ahead.cid AND t.pos = ahead.pos - 1))),
best AS (SELECT cid, b[1].c AS cost, b[1].a AS audit FROM ahead WHERE pos = 1),
walk AS (
  SELECT cid, audit, 0 AS i, 1 AS pos, 0 AS g, NULL::VARCHAR AS line FROM best
  UNION ALL
  SELECT cid, audit, i, pos, g, CASE e WHEN 'D' THEN NULL WHEN 'K' THEN role || ':' || text
    ELSE ['', 'user', 'assistant'][g] || ':' || CASE e WHEN 'R' THEN text ELSE '' END END
  FROM (SELECT w.cid, audit, i + 1 AS i, w.pos + (e <> 'I')::INT AS pos, t.role, t.text, e,
      CASE e WHEN 'D' THEN g WHEN 'K' THEN CASE t.ini WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE {list(follow)}[g + 1] END AS g
    FROM (SELECT *, substr(audit, i + 1, 1) AS e FROM walk WHERE i < length(audit)) w LEFT JOIN turns t ON t.cid = w.cid AND t.pos = w.pos)),
spoken AS (SELECT cid, string_agg(line, chr(10) ORDER BY i) AS said FROM walk GROUP BY cid),
counts AS (
  SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate,
    count_if(fault = 'truncated') AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY cid),
every AS (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS cid FROM conversations)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM every LEFT JOIN counts USING (cid) LEFT JOIN best USING (cid) LEFT JOIN spoken USING (cid)"""


def quoted(value) -> str:
    """A string or a nested list of strings as an SQL literal."""
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return "([" + ", ".join(quoted(v) for v in value) + "])"


NOTICES = ", ".join(f"('{name}', '{notice}')" for name, notice in licenses.TEMPLATES.items())

SQL: dict[str, str] = {
    "op2_jaccard_join": f"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '{WORDS}') AS w FROM documents),
shingle AS (
  SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT rid, count(*) AS n FROM shingle GROUP BY rid),
met AS (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM shingle x JOIN shingle y ON x.s = y.s AND x.rid <> y.rid GROUP BY ALL),
link AS (
  SELECT a, b FROM met JOIN size x ON x.rid = a JOIN size y ON y.rid = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach AS (SELECT rid, rid AS other FROM doc UNION SELECT reach.rid, link.b FROM reach JOIN link ON link.a = reach.other),
named AS (SELECT reach.rid, min(doc.doc_id) AS class_id FROM reach JOIN doc ON doc.rid = reach.other GROUP BY reach.rid),
counted AS (SELECT a AS rid, count(*) AS n_links FROM link GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM doc JOIN named USING (rid) LEFT JOIN counted USING (rid)""",
    "op4_chat_role_repair": chat_sql(),
    "op12_conversation_structure": structure_sql(),
    "op5_license_scan": f"""
WITH known AS (SELECT license, regexp_extract_all(translate(notice, {LETTERS}), '{WORDS}') AS w FROM (VALUES {NOTICES}) AS v(license, notice)),
template AS (
  SELECT license, list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS t FROM known),
sized AS (SELECT license, t, pow(2, ceil(log2(len(t))))::BIGINT AS span FROM template),
doc AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '{WORDS}') AS w FROM documents),
cut AS (SELECT rid, doc_id, [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] AS s FROM doc WHERE len(w) >= 3),
windows AS (
  SELECT rid, span, k * span AS window_start, list_distinct(s[k * span + 1:k * span + 2 * span]) AS part
  FROM (SELECT rid, s, span, unnest(range((len(s) - 1) // span + 1)) AS k FROM cut, (SELECT DISTINCT span FROM sized))),
met AS (
  SELECT rid, license, window_start, len(t) AS n_shingles, len(list_intersect(part, t)) AS n_found
  FROM windows JOIN sized USING (span) WHERE list_has_any(part, t)),
best AS (
  SELECT *, row_number() OVER (PARTITION BY rid, license ORDER BY n_found DESC, window_start) AS turn FROM met WHERE n_found >= 0.8 * n_shingles)
SELECT doc_id, license, n_found, n_shingles, window_start FROM best JOIN doc USING (rid) WHERE turn = 1""",
    "op6_quality_rules": f"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS lang, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
lines AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM doc) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
triples AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS times
  FROM (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM doc WHERE len(w) > 2))),
repeated AS (SELECT rid, count(*) AS n_repeat_words FROM (SELECT DISTINCT rid, unnest([i, i + 1, i + 2]) AS p FROM triples WHERE times > 1) GROUP BY rid),
base AS (
  SELECT rid, doc_id, lang, text, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(w) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed
  FROM doc LEFT JOIN lines USING (rid) LEFT JOIN repeated USING (rid)),
chars AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM base),
class AS (
  SELECT ch, CASE WHEN ch = chr(0) OR regexp_matches(ch, '[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\p{{Z}}]') THEN 1
    WHEN ch BETWEEN 'a' AND 'z' THEN unicode(ch) - 95 WHEN ch BETWEEN 'A' AND 'Z' THEN unicode(ch) - 63 WHEN ch BETWEEN '0' AND '9' THEN 28
    WHEN instr('.,;:!?''"()-', ch) > 0 THEN 29 WHEN unicode(ch) < 128 THEN 30 + unicode(ch) % 4
    WHEN unicode(ch) < 65536 THEN 34 + unicode(lower(ch)) % 6 ELSE 34 + unicode(ch) % 6 END AS s FROM chars WHERE ch <> ''),
folded AS (SELECT map(list(ch), list(s)) AS m FROM class),
coded AS (SELECT rid, lang, [0, 0, 0] || [m[c] FOR c IN string_split(text, '')] || [0] AS s FROM base, folded WHERE text <> ''),
gram AS (
  SELECT rid, lang, ((s[i - 3] * 40 + s[i - 2]) * 40 + s[i - 1]) * 40 + s[i] AS g
  FROM (SELECT rid, lang, s, unnest(range(4, len(s) + 1)) AS i FROM coded)),
c4 AS (SELECT lang, g, count(*) AS c FROM gram GROUP BY ALL),
c3 AS (SELECT lang, g % 64000 AS g, count(*) AS c FROM c4 GROUP BY ALL),
c2 AS (SELECT lang, g % 1600 AS g, count(*) AS c FROM c3 GROUP BY ALL),
c1 AS (SELECT lang, g % 40 AS g, count(*) AS c FROM c2 GROUP BY ALL),
{", ".join(f"""
k{n} AS (SELECT lang, count_if(c = 1)::DOUBLE AS n1, count_if(c = 2)::DOUBLE AS n2, count_if(c = 3)::DOUBLE AS n3, count_if(c = 4)::DOUBLE AS n4 FROM c{n} GROUP BY lang),
d{n} AS (
  SELECT lang, CASE WHEN least(n1, n2, n3) = 0 THEN [0.5, 0.75, 1.0] ELSE [
    greatest(0.05, least(0.95, 1 - 2 * n1 / (n1 + 2 * n2) * n2 / n1)), greatest(0.05, least(1.95, 2 - 3 * n1 / (n1 + 2 * n2) * n3 / n2)),
    greatest(0.05, least(2.95, 3 - 4 * n1 / (n1 + 2 * n2) * n4 / n3))] END AS d FROM k{n}),
e{n} AS (SELECT lang, g, c - d[least(c, 3)] AS rest, d[least(c, 3)] AS off, c FROM c{n} JOIN d{n} USING (lang)),
p{n} AS (
  SELECT e.lang, e.g, (rest + sum(off) OVER by_context * {"1 / 40::DOUBLE" if n == 1 else "l.p"}) / sum(c) OVER by_context AS p
  FROM e{n} e {"" if n == 1 else f"JOIN p{n - 1} l ON e.lang = l.lang AND e.g % {40 ** (n - 1)} = l.g"}
  WINDOW by_context AS (PARTITION BY e.lang, e.g // 40))""" for n in (1, 2, 3, 4))},
scored AS (SELECT rid, -sum(log2(p)) AS bits FROM gram JOIN p4 USING (lang, g) GROUP BY rid),
rated AS (SELECT base.*, bits / nullif(n_words, 0) AS rate FROM base LEFT JOIN scored USING (rid)),
bins AS (SELECT lang, floor(rate * 100) AS bin, count(*) AS c FROM rated WHERE NOT base_failed GROUP BY ALL),
upto AS (SELECT lang, bin, sum(c) OVER (PARTITION BY lang ORDER BY bin) AS u, sum(c) OVER (PARTITION BY lang) AS a FROM bins),
quarter AS (
  SELECT lang, min(CASE WHEN u >= a * 0.25 THEN (bin + 0.5) / 100 END) AS q0, min(CASE WHEN u >= a * 0.5 THEN (bin + 0.5) / 100 END) AS q1,
    min(CASE WHEN u >= a * 0.75 THEN (bin + 0.5) / 100 END) AS q2 FROM upto GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(rate BETWEEN q1 - greatest(1.5, 12 * (q1 - q0)) AND q1 + greatest(1.5, 12 * (q2 - q1)), FALSE) AS kept
FROM rated LEFT JOIN quarter USING (lang)""",
    "op8_positional_decontamination": f"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '{WORDS}') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '{WORDS}') AS w FROM documents),
place AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
met AS (SELECT rid, i, n, item_id FROM place JOIN windows USING (n, win)),
hit AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM met) GROUP BY rid),
listed AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM met) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (rid) LEFT JOIN listed USING (rid)""",
    "op9_jump_sharding": """
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
jumps AS (
  SELECT rid, shards, ((coalesce(doc_id, 0)::HUGEINT % 18446744073709551616) + 18446744073709551616) % 18446744073709551616 AS state,
    -1::BIGINT AS here, 0::BIGINT AS ahead FROM doc, (VALUES (16), (17)) AS v(shards)
  UNION ALL
  SELECT rid, shards, state, ahead, floor((ahead + 1)::DOUBLE * (2147483648::DOUBLE / ((state // 8589934592)::DOUBLE + 1)))::BIGINT
  FROM (SELECT rid, shards, ahead, (state * 2862933555777941757 + 1) % 18446744073709551616 AS state FROM jumps WHERE ahead < shards)),
placed AS (
  SELECT rid, max(here) FILTER (WHERE shards = 16)::INTEGER AS shard, max(here) FILTER (WHERE shards = 17)::INTEGER AS grown_shard FROM jumps GROUP BY rid),
entries AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)) AS t),
sums AS (
  SELECT rid, xor(list_reduce(regexp_extract_all(hex(text), '..'), lambda c, h: xor(c // 256, t[(xor(c % 256,
      (instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1) + 1)::BIGINT]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM doc, entries)
SELECT doc_id, strlen(text) + 1 AS size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, strlen(text), text_crc32) - 1 AS slot, grown_shard
FROM doc JOIN placed USING (rid) JOIN sums USING (rid)""",
}
