"""The registered queries of the numbered operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from issuetime.llm import conversations, exact_dedup, language_id, language_model, minhash, mixing, neighbours, packing, pii, token_files, toxicity, vector_codes, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words that the mix takes of it; null and blank texts have none to take."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), seed="mix")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set, its component and whether it stays; texts without words are linked with nothing."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and token ids in the files written, null as empty text, the end id appended."""
    return token_files.document_tokens(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans of personal data, null as empty text."""
    return pii.span_digest(pii.personal_data(_table(spark, sf_dir, "documents")))


def op5_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the archive written; null html as an empty payload."""
    return warc.record_table(spark, warc.write_archive(_table(spark, sf_dir, "pages")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's chances of low quality and toxicity; null and empty texts have the base rates."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base and model score; null as empty text, of which the end alone is scored."""
    return language_model.score_texts(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its packed sequence; null as empty text, of which the end id alone is packed."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays of its text; null, empty and blank texts are one text."""
    return exact_dedup.dedup_documents(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found of every query row; null, zero and non-finite vectors take no part."""
    return neighbours.nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector's code and errors; vectors that are null or hold null or non-finite components are left out."""
    codes = vector_codes.compress_vectors(_table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults and cheapest repair after damage; nulls in role and text as one space."""
    return conversations.damaged_and_repaired(_table(spark, sf_dir, "conversations"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from those not held out; und for null texts and texts without letters."""
    return language_id.identify_languages(_table(spark, sf_dir, "documents"), vocabulary_path())


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 2.0::DOUBLE * source_size AS cap
  FROM totals),
levels AS (
  SELECT *, cap / w AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS everything, sum(w) OVER () AS weights,
         coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
         coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights_before
  FROM weighed),
marked AS (SELECT *, (everything - caps_before) / (weights - weights_before) > ratio AS is_full FROM levels),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN cap
              ELSE (everything - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) / (weights - sum(CASE WHEN is_full THEN w ELSE 0 END) OVER ()) * w END AS target
  FROM marked),
placed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target::DOUBLE AS target,
       CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) END::BIGINT AS taken
FROM placed
"""

OP9_SQL = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
groups AS (SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM rows GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM rows JOIN groups USING (text_sha256)
"""

OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE array_to_string(w, ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM common c JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)),
reach AS (
  SELECT doc_id AS node, doc_id AS label FROM documents
  UNION
  SELECT links.v, reach.label FROM reach JOIN links ON links.u = reach.node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT node AS doc_id, min(label) AS component_id FROM reach GROUP BY node) r USING (doc_id)
"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {15 - 5 * k}) & 31)::INT + 1, 1)" for i in range(8) for k in range(4)
)
OP5_SQL = f"""
WITH rows AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT h, max(page_id) AS f FROM rows GROUP BY h)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM rows JOIN firsts USING (h)
"""

def _op11_sql(rounds: int = 4) -> str:
    """Codebooks are numbers per (part, entry, position); each round assigns every part and replaces the entries that were used."""
    assign = """SELECT x.r, x.p, min({{'d': x.d, 'e': x.e}}) AS best FROM (
        SELECT v.r, v.p, b.e, sum((v.x - b.x) * (v.x - b.x)) AS d FROM comps v JOIN book{0} b ON b.p = v.p AND b.j = v.j GROUP BY ALL) x GROUP BY ALL"""
    steps = []
    for k in range(rounds):
        steps.append(f"near{k} AS MATERIALIZED ({assign.format(k)})")
        steps.append(f"""book{k + 1} AS MATERIALIZED (
          SELECT b.p, b.e, b.j, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN (
            SELECT n.p, n.best.e AS e, v.j, floor(sum(v.x)::DOUBLE / count(*))::BIGINT AS x FROM near{k} n JOIN comps v ON v.r = n.r AND v.p = n.p GROUP BY ALL) m
          USING (p, e, j))""")
    return f"""
    WITH rows AS (
      SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    comps AS MATERIALIZED (SELECT r, (i - 1) // (n // 4) AS p, (i - 1) % (n // 4) AS j, x FROM (SELECT r, len(v) AS n, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM rows)),
    book0 AS MATERIALIZED (SELECT p, r - 1 AS e, j, x FROM comps WHERE r <= 256),
    {", ".join(steps)},
    last AS ({assign.format(rounds)}),
    coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM last GROUP BY r),
    digest AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM book{rounds})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM rows JOIN coded USING (r), digest
    """


OP11_SQL = _op11_sql()


def _option(cost: str, edit: str, line: str, state: int, when: str = "TRUE") -> str:
    """One edit before the values ``v<state>`` of the turns after it; unusable ones are dear."""
    return f"{{'c': CASE WHEN {when} THEN {cost} + v{state}.c ELSE 1000000000000 END, 'a': '{edit}' || v{state}.a, 't': {line} || v{state}.t}}"


def _state_value(state: int) -> str:
    """The cheapest of keeping, giving another role and deleting the turn in a state, as (cost, audit, lines) structs that compare in this order."""
    goes = {0: (("s", 1), ("u", 2)), 1: (("u", 2),), 2: (("a", 3),), 3: (("u", 2),)}[state]
    options = [_option("4", "D", "''", state)]
    for role, after in goes:
        options.append(_option("cut", "K", "chr(10) || role || ':' || text", after, f"NOT forced AND initial = '{role}'"))
        if role != "s":
            name = "user" if role == "u" else "assistant"
            options.append(_option("3 + cut", "R", f"chr(10) || '{name}:' || text", after, f"NOT forced AND initial <> '{role}'"))
    return f"least({', '.join(options)})"


def _with_inserts(state: int) -> str:
    one, two = (3, 2) if state == 2 else (2, 3)
    first, second = ("assistant", "user") if state == 2 else ("user", "assistant")
    return (
        f"least(w{state}, {{'c': 3 + w{one}.c, 'a': 'I' || w{one}.a, 't': chr(10) || '{first}:' || w{one}.t}}, "
        f"{{'c': 6 + w{two}.c, 'a': 'II' || w{two}.a, 't': chr(10) || '{first}:' || chr(10) || '{second}:' || w{two}.t}})"
    )


_STRUCT = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
OP12_SQL = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS what
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN what = 1 THEN '' WHEN what = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN what = 3 THEN 2 ELSE 1 END)) AS copy
  FROM marked WHERE what <> 0),
ordered AS (
  SELECT *, left(role, 1) AS initial, dense_rank() OVER (ORDER BY conv_id) AS g,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role)::VARCHAR || ':' || role || text)) AS i
  FROM damaged),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY g ORDER BY i) || initial AS pair
  FROM ordered),
turns AS (SELECT g, i, role, text, initial, fault IN ('blank', 'duplicate') AS forced, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS cut FROM faults),
back AS (
  SELECT g, max(i) + 1 AS i, {{'c': 0, 'a': '', 't': ''}}::{_STRUCT} AS v0, {{'c': 6, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}}::{_STRUCT} AS v1,
         {{'c': 3, 'a': 'I', 't': chr(10) || 'assistant:'}}::{_STRUCT} AS v2, {{'c': 0, 'a': '', 't': ''}}::{_STRUCT} AS v3
  FROM turns GROUP BY g
  UNION ALL
  SELECT g, i, {', '.join(f'({_with_inserts(s)})::{_STRUCT}' for s in range(4))}
  FROM (SELECT b.g, t.i, {', '.join(f'({_state_value(s)})::{_STRUCT} AS w{s}' for s in range(4))} FROM back b JOIN turns t ON t.g = b.g AND t.i = b.i - 1)),
sums AS (
  SELECT conv_id, g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum((fault = 'blank')::INT) AS blank, sum((fault = 'duplicate')::INT) AS duplicate,
         sum((fault = 'truncated')::INT) AS truncated, coalesce(sum((pair NOT IN ('su', 'ua', 'au'))::INT), 0) AS illegal
  FROM faults GROUP BY conv_id, g),
done AS (SELECT s.*, b.v0 FROM sums s JOIN back b ON b.g = s.g AND b.i = 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v0.c, 0)::BIGINT AS cost, coalesce(v0.a, '') AS audit, sha256(substr(coalesce(v0.t, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN done d ON o.conv_id IS NOT DISTINCT FROM d.conv_id
"""

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_token_files": op3_token_files,
    "op4_personal_data": op4_personal_data,
    "op5_web_archive": op5_web_archive,
    "op6_toxicity": op6_toxicity,
    "op7_language_model": op7_language_model,
    "op8_packing": op8_packing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_neighbours": op10_neighbours,
    "op11_vector_codes": op11_vector_codes,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_language_id": op13_language_id,
}
ORACLES = {"op1_mix_sources": OP1_SQL, "op2_near_duplicates": OP2_SQL, "op5_web_archive": OP5_SQL, "op9_exact_dedup": OP9_SQL, "op11_vector_codes": OP11_SQL, "op12_conversation_repair": OP12_SQL}
