"""The registered queries of this package and the SQL of those that have one."""

from __future__ import annotations

from pyspark.sql import functions as F

from .bpe import bpe_documents, read_ranks
from .common import read_table
from .context_mixing import mixing_scores
from .decontaminate import contamination
from .language import fit_identifier, identify
from .licenses import fit_licences, licence_scan
from .mtree import exact_top_k
from .near_duplicates import near_duplicates
from .pii import personal_data
from .secrets import secret_spans
from .sharding import balanced_shards
from .token_alignment import aligned_texts
from .toxicity import fit_toxicity, fold, score_toxicity
from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, vector_codes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op9_bpe_monoid(spark, sf_dir):
    """Whole texts of documents by the multilingual byte-level vocabulary."""
    import public_tokenizers as public

    ranks = read_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    return bpe_documents(read_table(spark, sf_dir, "documents"), ranks, public.PATTERN, digests=True)


@query
def op1_fm_decontaminate(spark, sf_dir):
    """Occurrences of ten-word windows of every benchmark item in every document."""
    return contamination(read_table(spark, sf_dir, "documents"),
                         read_table(spark, sf_dir, "benchmark")).drop("items", "spans")


_OP1_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op1_fm_decontaminate"] = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_OP1_WORDS} AS w FROM documents),
i AS MATERIALIZED (SELECT item_id, {_OP1_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p
        FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
o AS MATERIALIZED (SELECT doc_id, item_id, k, p FROM dw JOIN iw USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM o) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM o) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)"""


@query
def op2_guess_cost_secrets(spark, sf_dir):
    """Base and guess-cost spans of every document."""
    return secret_spans(read_table(spark, sf_dir, "documents"))


@query
def op4_karmarkar_karp(spark, sf_dir):
    """All documents in 16 shards of near equal bytes."""
    return balanced_shards(read_table(spark, sf_dir, "documents"), 16)


@query
def op5_mtree_top_k(spark, sf_dir):
    """The 5 best of all other vectors for every 50th vector."""
    return exact_top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


ORACLES["op5_mtree_top_k"] = """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


@query
def op7_cnn_toxicity(spark, sf_dir):
    """Scores of every document; rows with crc32(doc_id) mod 4 = 2 are not learnt from."""
    docs = read_table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"), train_rows=fold("id", 4) != 2, whole=True)
    return score_toxicity(docs, model).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), "toxic")


@query
def op6_sketch_near_duplicates(spark, sf_dir):
    """Components of documents whose four-word shingles are 80 % alike."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), k=4, percent=80)


ORACLES["op6_sketch_near_duplicates"] = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + least(len(w), 4) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
       doc_id <= coalesce(m, doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY 1) USING (doc_id)"""


@query
def op10_context_mixing(spark, sf_dir):
    """log10 probabilities of every document; rows with crc32(doc_id) mod 7 = 2
    are not learnt from."""
    return mixing_scores(read_table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)


@query
def op3_information_pii(spark, sf_dir):
    """Base spans and disclosing terms of every document."""
    return personal_data(read_table(spark, sf_dir, "documents"))


@query
def op8_licence_paragraphs(spark, sf_dir):
    """Licence families that the paragraphs of every document name."""
    docs = read_table(spark, sf_dir, "documents")
    return licence_scan(docs, fit_licences(docs))


@query
def op11_orchard_codes(spark, sf_dir):
    """Product codes of every vector, entries found by Orchard search."""
    return vector_codes(read_table(spark, sf_dir, "embeddings")).drop("label")


def _codes_sql() -> str:
    """Rounds as one table each: all distances, the least (squared distance,
    index), and the floors of the means."""
    near = """a{r} AS MATERIALIZED (
  SELECT uid, p.part, min(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * {k} + entry) AS m
  FROM p JOIN b{r} AS b ON p.part = b.part GROUP BY ALL)"""
    mean = """m{r} AS (
  SELECT part, entry, list(y ORDER BY place) AS x FROM (
    SELECT part, entry, place, CAST(floor(sum(y) / count(*)) AS BIGINT) AS y FROM (
      SELECT p.part, a.m % {k} AS entry, unnest(p.x) AS y, generate_subscripts(p.x, 1) AS place
      FROM a{q} AS a JOIN p ON a.uid = p.uid AND a.part = p.part) GROUP BY ALL) GROUP BY part, entry),
b{r} AS MATERIALIZED (SELECT * FROM m{r} UNION ALL SELECT b.* FROM b{q} AS b ANTI JOIN m{r} AS m ON b.part = m.part AND b.entry = m.entry)"""
    steps = [near.format(r=0, k=ENTRIES)]
    for r in range(1, ROUNDS + 1):
        steps += [mean.format(r=r, q=r - 1, k=ENTRIES), near.format(r=r, k=ENTRIES)]
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS uid, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT uid, part, x[part * len(x) // {PARTS} + 1:(part + 1) * len(x) // {PARTS}] AS x FROM v, range({PARTS}) AS t(part)),
b0 AS MATERIALIZED (SELECT part, CAST(uid - 1 AS HUGEINT) AS entry, x FROM p WHERE uid <= {ENTRIES}),
{", ".join(steps)},
f AS (SELECT uid, string_agg(printf('%02x', CAST(m % {ENTRIES} AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(m // {ENTRIES}) AS BIGINT) AS error
      FROM a{ROUNDS} GROUP BY uid),
s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN f USING (uid), s"""


ORACLES["op11_orchard_codes"] = _codes_sql()


@query
def op12_pair_alignment(spark, sf_dir):
    """Tokens of two vocabularies that cover the same bytes, in every document."""
    import public_tokenizers as public

    return aligned_texts(read_table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"))


@query
def op13_kneser_ney_language(spark, sf_dir):
    """Languages of every document; rows with crc32(doc_id) mod 4 = 2 are not learnt from."""
    docs = read_table(spark, sf_dir, "documents")
    model = fit_identifier(docs, fold("id", 4) != 2, whole=True)
    return identify(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected", "bits_per_char")
