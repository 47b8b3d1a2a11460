"""The registered queries of the corpus operators and, where SQL can express them, their plain-SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from heatgrid.llm import ann, chat_format, decontam, langid, license_scan, minhash, packing, quality, repair, substring, token_count, token_output, vector_codes
from heatgrid.llm.common import shared_folder
from heatgrid.operators.support import local_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _fold(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def tokenizer_file(name: str) -> str:
    """Where the public vocabulary files are installed (the folder is the package `public_tokenizers`)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def packed_documents(docs: DataFrame) -> DataFrame:
    """The documents' pieces in sequences, each with the checksum of its ids."""
    pieces = packing.piece_documents(docs, tokenizer_file("word_bpe_49k.json"))
    narrow = pieces.select("doc_id", "piece", "start", "length", F.crc32("token_ids").alias("ids_crc32"))
    return packing.pack(narrow).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")


@query("op1_packing")
def op1_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packed_documents(table(spark, sf, "documents"))


@query("op2_licenses")
def op2_licenses(spark: SparkSession, sf: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices")


@query("op3_neighbours")
def op3_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return ann.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query("op4_decontamination", f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    b2 AS (SELECT item_id, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0),
    win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM b2)),
    dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
    hits AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN win ON dw.m = win.m AND dw.win = win.win),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hits)) GROUP BY 1),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY 1)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontam.find_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontam.items_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op5_substrings", r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
    again AS (SELECT doc_id, i FROM win WHERE win IN (SELECT win FROM win GROUP BY 1 HAVING count(*) > 1)),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM again),
    word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""")
def op5_substrings(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    values = substring.remove_repeats(docs).select("k1", "k2", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return substring.per_document(docs, values, [F.col("doc_id")]).select("row.doc_id", "n_words", "n_removed", "kept_sha256")


@query("op6_quality")
def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs, held_out = table(spark, sf, "documents").select("doc_id", "text"), _fold(5) == 0
    labels = table(spark, sf, "labels").select("doc_id", "quality").where(~held_out)
    model = quality.fit_quality(docs, labels, label="quality")
    return quality.score_quality(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "score", "predicted")


@query("op7_language")
def op7_language(spark: SparkSession, sf: str) -> DataFrame:
    docs, held_out = table(spark, sf, "documents"), _fold(4) == 2
    model = langid.fit_language(docs.where(~held_out).select("text", "lang"))
    return langid.predict_language(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")


@query("op8_near_duplicates", f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    s AS (SELECT doc_id, sh, count(*) AS c FROM (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)) GROUP BY 1, 2),
    n AS (SELECT doc_id, sum(c) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.c, b.c)) AS v FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 5 * v >= 4 * (a.n + b.n - v)),
    e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    cc AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.y, cc.c FROM cc JOIN e ON cc.doc_id = e.x)
    SELECT doc_id, min(c) AS class_id FROM cc GROUP BY 1""")
def op8_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.classes(table(spark, sf, "documents"))


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query("op10_token_ids")
def op10_token_ids(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    token_output.write_token_ids(table(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.json"), path)
    back = token_output.read_token_ids(spark, path)
    return back.select("doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))


#: The 256 values of a byte in CRC-32, as DuckDB SQL.
_CRC_TABLE = ("(SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), "
              "lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc)")


def _crc32(text: str) -> str:
    """DuckDB SQL for the CRC-32 of an ASCII string, with the table as column `crc`."""
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)), "
            "lambda c, b: xor(c // 256, crc[(xor(c, b) & 255) + 1])), 4294967295)")


def _edit(weight: str, cost: str, letter: str) -> str:
    """A weight (eight digits of cost, then the audit) after one more edit."""
    return f"(lpad(CAST(CAST(left({weight}, 8) AS INT) + {cost} AS VARCHAR), 8, '0') || substr({weight}, 9) || '{letter}')"


_U = f"least(u, {_edit('s', '3', 'I')}, {_edit('y', '3', 'I')}, {_edit('a', '3', 'I')})"
_BARE = r"rtrim(text, E' \t\n\x0b\f\r')"
_REPAIR_SQL = f"""WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations, {_CRC_TABLE}),
    dam AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE k WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM keyed WHERE k <> 0),
    num AS (SELECT conv_id, turn, role, text, left(role, 1) AS c, {_BARE} AS bare, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM dam),
    f AS (SELECT *, bare = '' AS blank, bare <> '' AND again AS dup, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut,
        lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS two FROM num),
    w AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '00000000' AS s, CAST(NULL AS VARCHAR) AS y, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM f
        UNION ALL SELECT conv_id, i + 1, {_edit('s', '4', 'D')},
            least({_edit('y', '4', 'D')}, CASE WHEN free AND c = 's' THEN {_edit('s', 't', 'K')} END),
            least({_edit('u', '4', 'D')}, CASE WHEN free AND c = 'u' THEN least({_edit('s', 't', 'K')}, {_edit('y', 't', 'K')}, {_edit('a', 't', 'K')}) END,
                CASE WHEN free THEN least({_edit('s', '3 + t', 'R')}, {_edit('y', '3 + t', 'R')}, {_edit('a', '3 + t', 'R')}) END),
            least({_edit('a', '4', 'D')}, CASE WHEN free AND c = 'a' THEN {_edit('u', 't', 'K')} END, CASE WHEN free THEN {_edit('u', '3 + t', 'R')} END)
        FROM (SELECT v.*, f.c, NOT (blank OR dup) AS free, CASE WHEN cut THEN 3 ELSE 0 END AS t
            FROM (SELECT conv_id, i, s, y, u, least(a, {_edit('u', '3', 'I')}) AS a FROM (SELECT conv_id, i, s, y, {_U} AS u, a FROM w)) v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i + 1)),
    best AS (SELECT conv_id, least(s, a, {_edit(_U, '3', 'I')}) AS w FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
    edit AS (SELECT conv_id, unnest(string_split(substr(w, 9), '')) AS e, unnest(range(1, length(w) - 7)) AS p FROM best WHERE length(w) > 8),
    ed AS (SELECT *, count(*) FILTER (WHERE e <> 'I') OVER g AS i, count(*) FILTER (WHERE e <> 'D') OVER g AS m FROM edit WINDOW g AS (PARTITION BY conv_id ORDER BY p)),
    said AS (SELECT ed.conv_id, p, e, m, role, CASE e WHEN 'I' THEN '' ELSE text END AS text, CAST(bool_or(e = 'K' AND m = 1 AND c = 's') OVER (PARTITION BY ed.conv_id) AS INT) AS sys
        FROM ed JOIN f ON f.conv_id IS NOT DISTINCT FROM ed.conv_id AND f.i = greatest(ed.i, 1) WHERE e <> 'D'),
    fixed AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (m - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS text FROM said GROUP BY 1),
    n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate,
        count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE two IS NOT NULL AND two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
    SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
        coalesce(illegal, 0) AS illegal, CAST(coalesce(left(w, 8), '0') AS BIGINT) AS cost, coalesce(substr(w, 9), '') AS audit, sha256(coalesce(fixed.text, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN fixed ON fixed.conv_id IS NOT DISTINCT FROM o.conv_id"""


@query("op11_conversation_repair", _REPAIR_SQL)
def op11_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    talks = table(spark, sf, "conversations")
    return repair.repair_report(repair.damage(talks), all_conversations=talks)


def _codebook_round(n: int) -> str:
    """One assignment of all parts to the entries of codebook n, and codebook n + 1."""
    return f"""d{n} AS (SELECT vec_id, part, entry, sum((q - c) * (q - c)) AS dist FROM part JOIN c{n} USING (part, j) GROUP BY 1, 2, 3),
    a{n} AS (SELECT vec_id, part, entry, dist FROM d{n} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY dist, entry) = 1),
    c{n + 1} AS (SELECT part, entry, j, coalesce(m, c) AS c FROM c{n} LEFT JOIN (SELECT part, entry, j, CAST(floor(CAST(sum(q) AS DOUBLE) / count(*)) AS BIGINT) AS m
        FROM part JOIN a{n} USING (vec_id, part) GROUP BY 1, 2, 3) USING (part, entry, j)),"""


_CODES_SQL = f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    part AS (SELECT vec_id, CAST(j // w AS INT) AS part, CAST(j % w AS INT) AS j, q FROM (SELECT vec_id, len(q) // 16 AS w, unnest(q) AS q, unnest(range(len(q))) AS j FROM kept)),
    c0 AS (SELECT part, entry, j, q AS c FROM part JOIN (SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INT) AS entry FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id)),
    {_codebook_round(0)} {_codebook_round(1)} {_codebook_round(2)}
    code AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a2 GROUP BY 1),
    books AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, j)) AS codebooks_sha256 FROM c2)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM code JOIN kept USING (vec_id), books"""


@query("op12_vector_codes", _CODES_SQL)
def op12_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return vector_codes.compress_vectors(table(spark, sf, "embeddings"))


_ESCAPED = r"""regexp_replace(regexp_replace({0}, '(<)(\\*)(s>|/s>|\|endoftext\|>)', '\1\\\2\3', 'g'), '(\[)(\\*)(/?INST\]|/?SYS\]|/?ROLE\]|/TURN\])', '\1\\\2\3', 'g')"""
_SAMPLE_CHAT = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
_CHAT_SQL = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES {', '.join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in _SAMPLE_CHAT)}),
    e AS (SELECT *, length({_ESCAPED.format('text')}) + CASE role WHEN 'user' THEN length('<s>[INST][/INST]') WHEN 'assistant' THEN length('</s>') WHEN 'system' THEN length('[SYS][/SYS]')
        ELSE length('[ROLE][/ROLE][/TURN]') + length({_ESCAPED.format('role')}) END AS n FROM t),
    c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role) AS said,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '') AS loss, sum(n) AS formatted FROM e GROUP BY 1)
    SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars FROM c"""


@query("op13_chat_format", _CHAT_SQL)
def op13_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    talks = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    path, tokenizer = f"{shared_folder(spark)}/chats-{uuid.uuid4().hex}", tokenizer_file("byte_bpe_50k.json")
    chat_format.write_chats(talks.unionByName(local_table(spark, _SAMPLE_CHAT, talks.schema)), tokenizer, path)
    return chat_format.read_digests(spark, path, tokenizer)
