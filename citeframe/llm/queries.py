"""Registered queries of the operators, and their SQL where DuckDB can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeframe.llm import chat, decontamination, disclosure, html_text, licenses, neighbours, quality, sharding, simhash, suffixes, tokens, turn_repair, vector_codes
from citeframe.plans.views import table
from citeframe.sources import scratch

N_SHARDS = 8


def _crc32(text) -> F.Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    sizes = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"), _crc32(text).alias("text_crc32")
    )
    slotted = sharding.with_slot(sizes, ["doc_id"])
    path = scratch.new_path(spark, "slot-map")
    sharding.store_balanced_map(spark, slotted, "size", N_SHARDS, path)
    placed = sharding.place(slotted, sharding.read_map(spark, path), ["doc_id", "text_crc32", "size"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = tokens.encode(spark, docs, verify=True)
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "round_trip")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    length = F.aggregate("removed", F.lit(0).cast("bigint"), lambda total, run: total + run["end"] - run["start"])
    done = suffixes.remove_repeats(spark, docs).withColumn("n_removed", length)
    return done.select(
        "doc_id", (F.octet_length("kept") + F.col("n_removed")).alias("n_bytes"), "n_removed",
        F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    back = chat.read_back(chat.format_conversations(turns.union(planted)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("learnt").cast("bigint").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"), "n_escaped",
    )


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    n_hit = decontamination.n_covered(F.col("hits"))
    return found.select(
        "doc_id", F.col("n_words").cast("bigint").alias("n_words"), n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op5_proximity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.proximity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "item_id", F.col("n").alias("n_agreeing"), F.col("length").alias("n_terms"), (F.col("n") / F.col("length")).alias("agreement"),
        "low", "high",
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), quality.score(F.col("text"), model).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest_neighbours(spark, vectors, F.col("vec_id") % 100 == 0)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), "component_id")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = disclosure.find_spans(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = disclosure.KINDS + disclosure.ADDED
    rank = F.create_map(*[F.lit(x) for pair in zip(kinds, range(len(kinds)), strict=True) for x in pair])

    def listed(spans):
        placed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], rank[s["kind"]], s["end"], s["kind"])))
        said = F.transform(placed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(said, ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in disclosure.KINDS]
    return docs.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))


def _damaged(turns: DataFrame) -> DataFrame:
    """Rows with the faults that their conversation and turn numbers choose."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat_ws(":", *named).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault")).filter("fault != 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    done = turn_repair.repair(spark, _damaged(turns))
    found = done.conversations.withColumnRenamed("conv_id", "of")
    hashed = turn_repair.digests(done).select(F.col("conv_id").alias("also"), "repaired_sha256")
    every = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    every = every.join(hashed, F.col("conv_id").eqNullSafe(F.col("also")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit(""), 256)
    return every.select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256")
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = vector_codes.compress(spark, table(spark, sf_dir, "embeddings"), carry=("label",))
    path = scratch.new_path(spark, "vector-codes")
    done.coded.write.parquet(path)
    coded = spark.read.parquet(path)
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(done.digest()).alias("codebooks_sha256")
    )


_FAMILY = chat.LLAMA_STYLE.family.replace("'", "''")
_FRAME = len(chat.LLAMA_STYLE.open_turn + chat.LLAMA_STYLE.close_role + chat.GAP + chat.LLAMA_STYLE.end_turn)

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _vector_code_sql(rounds: int = 2, parts: int = 16, entries: int = 64) -> str:
    """Each round as three steps: nearest entries, their sums, the next codebooks."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
        f{i} AS (
          SELECT vec_id, label, p, e, sum((u.x - b{i}.x) * (u.x - b{i}.x)) AS far
          FROM u JOIN b{i} USING (p, j) GROUP BY vec_id, label, p, e),
        n{i} AS (SELECT vec_id, label, p, min(far) AS far, min(e) FILTER (far = least) AS e
          FROM (SELECT *, min(far) OVER (PARTITION BY vec_id, p) AS least FROM f{i}) GROUP BY vec_id, label, p)""")
        if i < rounds:
            steps.append(f"""
        b{i + 1} AS (
          SELECT p, e, j, coalesce(s.x, b{i}.x) AS x FROM b{i} LEFT JOIN (
            SELECT p, e, j, floor(sum(u.x)::DOUBLE / count(*))::BIGINT AS x
            FROM n{i} JOIN u USING (vec_id, p) GROUP BY p, e, j) s USING (p, e, j))""")
    return f"""
        WITH k AS (
          SELECT vec_id, label, embedding AS v FROM embeddings
          WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
        u AS (
          SELECT vec_id, label, i * {parts} // len(v) AS p, i % (len(v) // {parts}) AS j,
            floor(256 * v[i + 1]::DOUBLE)::BIGINT AS x
          FROM (SELECT *, unnest(range(len(v))) AS i FROM k)),
        b0 AS (
          SELECT p, e, j, x FROM u JOIN (
            SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k) USING (vec_id) WHERE e < {entries}),{",".join(steps)},
        h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM b{rounds}),
        c AS (
          SELECT vec_id, label, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(far)::BIGINT AS error
          FROM n{rounds} GROUP BY vec_id, label)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM c, h"""


def _edit(cell: str, cost: str, letter: str, turn: str) -> str:
    return f"CASE WHEN {cell} IS NULL THEN NULL ELSE {{'c': {cell}.c + {cost}, 'a': {cell}.a || '{letter}', 'r': {cell}.r || {turn}}} END"


def _turn_repair_sql() -> str:
    """Row by row: the least (cost, audit) that reaches each state, with the repaired turns beside it."""
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    kept = "chr(10) || role || ':' || text"

    def changed(cells: tuple[str, ...], initial: str, turn: str) -> list[str]:
        out = []
        for cell in cells:
            out.append(f"CASE WHEN NOT gone AND x = '{initial}' THEN {_edit(cell, 'cut', 'K', kept)} END")
            out.append(f"CASE WHEN NOT gone AND x != 's' THEN {_edit(cell, '2 + cut', 'R', turn + ' || text')} END")
            out.append(f"CASE WHEN NOT gone AND x = 's' THEN {_edit(cell, '2 + cut', 'R', turn + ' || text')} END")
        return out

    def least(*cells: str) -> str:
        return f"list_min([{', '.join(cells)}])"

    t0 = _edit("v0", "3", "D", "''")
    t1 = least(_edit("v1", "3", "D", "''"), f"CASE WHEN NOT gone AND x = 's' THEN {_edit('v0', 'cut', 'K', kept)} END")
    t2 = least(_edit("v2", "3", "D", "''"), *changed(("v0", "v1", "v3"), "u", user))
    t3 = least(_edit("v3", "3", "D", "''"), *changed(("v2",), "a", assistant))
    to2 = least("t2", *[_edit(c, "2", "I", user) for c in ("t0", "t1", "t3")])
    spaces, none = r"[^\x20\x09-\x0D]", "sha256('')"
    return rf"""
        WITH RECURSIVE t AS (
          SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS k FROM conversations),
        o AS (
          SELECT coalesce(conv_id::VARCHAR, ' ') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
        q AS (SELECT DISTINCT name, encode(name) AS b, octet_length(encode(name)) AS n FROM o),
        crc AS (
          SELECT name, b, n, 0 AS i, 4294967295::BIGINT AS h FROM q
          UNION ALL
          SELECT name, b, n, i + 1, {_crc_step("xor(h, ascii(substr(name, i + 1, 1))::BIGINT)")} FROM crc WHERE i < n),
        f AS (SELECT name, xor(h, 4294967295::BIGINT) % 20 AS fault FROM crc WHERE i = n),
        d AS (
          SELECT k, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
            CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy
          FROM o JOIN f USING (name) WHERE fault != 0),
        n AS (
          SELECT *, row_number() OVER w AS i, left(role, 1) AS x, lag(left(role, 1)) OVER w AS y, count(*) OVER (PARTITION BY k) AS n,
            row_number() OVER (PARTITION BY k, role, text ORDER BY turn NULLS FIRST) > 1 AS again,
            NOT regexp_matches(text, '{spaces}') AS blank,
            regexp_extract(text, '({spaces})[ 	-
]*$', 1) NOT IN ('.', '!', '?') AS open
          FROM d WINDOW w AS (PARTITION BY k ORDER BY turn NULLS FIRST, role, text)),
        e AS (SELECT *, blank OR again AS gone, (open AND NOT blank)::BIGINT AS cut FROM n),
        s AS (
          SELECT k, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank,
            count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (open AND NOT again AND NOT blank) AS truncated,
            count(*) FILTER (i > 1 AND y || x NOT IN ('su', 'ua', 'au')) AS illegal
          FROM e GROUP BY k),
        p AS (
          SELECT k, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS v0, NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR) AS v1,
            {{'c': 2::BIGINT, 'a': 'I', 'r': {user}}} AS v2, {{'c': 4::BIGINT, 'a': 'II', 'r': {user} || {assistant}}} AS v3 FROM s
          UNION ALL
          SELECT k, i, t0, t1, u2, {least("t3", _edit("u2", "2", "I", assistant))} FROM (
            SELECT *, {to2} AS u2 FROM (
              SELECT p.k, e.i, {t0} AS t0, {t1} AS t1, {t2} AS t2, {t3} AS t3 FROM p JOIN e ON p.k = e.k AND e.i = p.i + 1))),
        g AS (SELECT p.k, {least("v0", "v3")} AS v FROM p JOIN (SELECT k, max(i) AS i FROM e GROUP BY k) USING (k, i))
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
          coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v.c, 0) AS cost, coalesce(v.a, '') AS audit,
          coalesce(sha256(substr(v.r, 2)), {none}) AS repaired_sha256
        FROM t LEFT JOIN s USING (k) LEFT JOIN g USING (k)"""


def _crc_step(value: str) -> str:
    """Eight shifts of the reversed CRC-32 polynomial."""
    for _ in range(8):
        value = f"(SELECT xor(z >> 1, (z & 1) * 3988292384) FROM (SELECT {value} AS z))"
    return value


ORACLE_SQL = {
    "op12_turn_repair": _turn_repair_sql(),
    "op13_vector_codes": _vector_code_sql(),
    "op5_benchmark_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        k AS (SELECT item_id, w, least(10, len(w)) AS l FROM i WHERE len(w) > 0),
        windows AS (
          SELECT DISTINCT item_id, l, array_to_string(w[s:s + l - 1], ' ') AS t
          FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS s FROM k)),
        places AS (
          SELECT r, l, p, array_to_string(w[p:p + l - 1], ' ') AS t
          FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, (SELECT DISTINCT l FROM k))),
        found AS (SELECT r, item_id, p, l FROM places JOIN windows USING (l, t)),
        hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + l)) AS q FROM found) GROUP BY r),
        ids AS (
          SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x
          FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM found) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
          sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)""",
    "op4_chat_formatting": rf"""
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
          UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        w AS (
          SELECT *, length(regexp_replace(role, '{_FAMILY}', '\1\\\2\3', 'g'))
                  + length(regexp_replace(text, '{_FAMILY}', '\1\\\2\3', 'g')) + {_FRAME} AS n,
            regexp_matches(role, '{_FAMILY}') OR regexp_matches(text, '{_FAMILY}') AS dirty
          FROM t),
        c AS (
          SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learnt,
            sum(n)::BIGINT AS formatted_chars, count(*) FILTER (dirty) AS n_escaped
          FROM w GROUP BY conv_id)
        SELECT conv_id, n_turns, turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256,
          formatted_chars, n_escaped FROM c""",
}

_ALL = (
    op1_sharding, op2_sentencepiece, op3_suffix_array_dedup, op4_chat_formatting, op5_benchmark_decontamination,
    op5_proximity_matches, op6_license_scan, op7_quality_classifier, op8_nearest_neighbours, op9_html_extraction, op10_simhash_near_dedup,
    op11_personal_data, op12_turn_repair, op13_vector_codes,
)
QUERIES = {q.__name__: q for q in _ALL}
