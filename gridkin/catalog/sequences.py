"""k-mers, polynomial hashes, FASTA and anchor similarity.

Documents stand in for sequences: letters are mapped onto the four nucleotides in turn; everything
else (accents, digits, punctuation, line ends) stays and breaks k-mers.
"""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from gridkin.catalog import inputs as src
from gridkin.catalog.signatures import kron_minima_sql, minima_sql, tt_minima_sql
from gridkin.functions.hashing import poly_hash
from gridkin.functions.text import is_dna
from gridkin.operators.filters import spread
from gridkin.operators.families import ClassicFamily, KronFamily, TTFamily
from gridkin.operators.sequences import (
    kmer_table,
    piece_kmers,
    piece_records,
    sequence_kmers,
    sequence_profile,
    sequence_sets,
)
from gridkin.operators.storage import scratch_path, write_and_read
from gridkin.plans.sequences import long_sequence_similarity, sequence_similarity
from gridkin.sources.fasta import read_fasta, read_fasta_pieces, write_fasta

LETTERS = string.ascii_lowercase + string.ascii_uppercase
BASES = ("ACGT" * 7)[:26] * 2
K = 12
SHAPE = (64, 64, 64)
FAMILY_SHAPE = (32, 32, 32)
PRIME = 2147483647


def _sequences(spark, sf):
    docs = spread(src.table(spark, sf, "documents").select("doc_id", "text"))
    seq = F.regexp_replace(F.translate("text", LETTERS, BASES), " ", "")
    return docs.select(F.col("doc_id").alias("seq_id"), seq.alias("seq"))


def _customer_sequences(spark, sf):
    """Short sequences: customer name and segment, letters mapped likewise."""
    customers = src.table(spark, sf, "customer")
    text = F.translate(F.concat("c_mktsegment", "c_name"), LETTERS, BASES)
    return customers.select(F.col("c_custkey").alias("seq_id"), text.alias("seq"))


def _kmer_summary(place=None):
    """How many, the first, the last, and a sum over all of them that no other set of k-mers is likely to have."""
    number = F.conv(F.substring(F.md5("kmer"), 1, 10), 16, 10).cast("long")
    # Numbers to the base of four are in the order of the letters; unlike strings they are aggregated in place,
    # without a sort of all k-mers.
    place = F.conv(F.translate("kmer", "ACGT", "0123"), 4, 10).cast("long") if place is None else place
    kmer = lambda n: F.translate(F.lpad(F.conv(n.cast("string"), 10, 4), K, "0"), "0123", "ACGT")
    return [
        F.count(F.lit(1)).alias("n_kmers"), kmer(F.min(place)).alias("first"), kmer(F.max(place)).alias("last"),
        F.sum(number).alias("digest"),
    ]


def kmer_sets(spark, sf):
    """Distinct k-mers per document."""
    return sequence_kmers(_sequences(spark, sf), K).groupBy("seq_id").agg(*_kmer_summary())


def _fasta_pieces(spark, sf):
    """Documents' plain letters as nucleotides, written as wrapped FASTA and read back in pieces."""
    docs = spread(src.table(spark, sf, "documents").select("doc_id", "text"))
    seq = F.translate(F.regexp_replace("text", "[^A-Za-z]", ""), LETTERS, BASES)
    path = scratch_path(spark, "fasta")
    write_fasta(docs.select(F.concat(F.lit("doc "), "doc_id").alias("header"), seq.alias("seq")), path)
    return read_fasta_pieces(spark, path)


def fasta_pieces(spark, sf):
    """Letters and distinct k-mers of every record of FASTA files that are read in byte ranges."""
    pieces = _fasta_pieces(spark, sf)
    # A number for each name of a file, which every k-mer has beside it.
    names = pieces.select("file").distinct().withColumn("file_no", F.monotonically_increasing_id())
    names = write_and_read(names, "file-names")
    named = pieces.join(names, "file")
    key = ["file_no", "record"]
    found = piece_kmers(named, K, key, numbered=True).groupBy(*key).agg(*_kmer_summary(F.col("place")))
    return (
        piece_records(named, key)
        .join(found, key, "left")
        .select("header", "n_letters", F.coalesce("n_kmers", F.lit(0)).alias("n_kmers"), "first", "last", "digest")
    )


def long_sequence_anchor(spark, sf):
    """Records of FASTA files against the record of document 0, classic family."""
    number = F.regexp_extract("header", r"(\d+)", 1).cast("long")
    pieces = _fasta_pieces(spark, sf).withColumn("seq_id", number)
    out = long_sequence_similarity(pieces, 0, kmer=K, shape=SHAPE, families=[ClassicFamily(32)])
    return out.select(
        "set_id", "pair", "method", F.round("exact", 9).alias("exact"), "est",
        F.round("error", 9).alias("error"), "similarity",
    )


def kmer_table_short(spark, sf):
    """k-mers of short sequences by built-ins only."""
    return kmer_table(_customer_sequences(spark, sf), 4)


def profile(spark, sf):
    return sequence_profile(_sequences(spark, sf), K)


def poly_hash_cells(spark, sf):
    """Grid cells of all k-mers of whole documents: number and sums per document."""
    sets = sequence_sets(_sequences(spark, sf), K, SHAPE)
    total = lambda value: F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + value(c))
    return sets.select(
        "set_id",
        F.size("cells").cast("long").alias("n_cells"),
        total(lambda c: c).alias("sum_cells"),
        total(lambda c: c * c % 1_000_003).alias("sum_squares"),
    )


def poly_hash_values(spark, sf):
    """Polynomial hashes of part names under the three bases."""
    parts = src.table(spark, sf, "part").select("p_partkey", "p_name")
    return parts.select("p_partkey", *[poly_hash("p_name", b).alias(f"h{b}") for b in (31, 37, 41)])


def alphabet_check(spark, sf):
    """Words of documents that happen to be nucleotide strings."""
    words = spread(src.table(spark, sf, "documents").select("text")).select(
        F.explode(F.split("text", " ")).alias("word")
    )
    return words.where(is_dna("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def fasta_scan(spark, sf):
    """Documents' plain letters written as FASTA, read back and fingerprinted."""
    docs = spread(src.table(spark, sf, "documents").select("doc_id", "text"))
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    rows = docs.select(F.concat(F.lit("doc "), "doc_id").alias("header"), letters.alias("seq"))
    path = scratch_path(spark, "fasta")
    write_fasta(rows, path)
    return read_fasta(spark, path).select(
        "header", F.length("seq").cast("long").alias("n_letters"), F.md5("seq").alias("digest")
    )


def sequence_anchor(spark, sf):
    """Documents as sequences against document 0, classic family."""
    out = sequence_similarity(
        _sequences(spark, sf), 0, kmer=K, shape=SHAPE, families=[ClassicFamily(32)]
    )
    return out.select(
        "set_id", "pair", "method", F.round("exact", 9).alias("exact"), "est",
        F.round("error", 9).alias("error"), "similarity",
    )


def sequence_anchor_all(spark, sf):
    """The same under all three families."""
    families = [
        ClassicFamily(32), KronFamily(16, 42, FAMILY_SHAPE, "md5"), TTFamily(8, 42, FAMILY_SHAPE, 2, "md5")
    ]
    out = sequence_similarity(_sequences(spark, sf), 0, kmer=K, shape=FAMILY_SHAPE, families=families)
    return out.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("error"), 6).alias("mae"),
        F.round(F.max("error"), 6).alias("max_error"),
    )


_TEXT_SQL = f"replace(translate(text, '{LETTERS}', '{BASES}'), ' ', '')"
_LETTERS_SQL = f"translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{LETTERS}', '{BASES}')"
_SEQ_SQL = f"""
      seqs AS (SELECT doc_id AS seq_id, {_TEXT_SQL} AS seq FROM documents),
      runs AS (SELECT seq_id, unnest(regexp_extract_all(seq, '[ACGT]{{{K},}}')) AS run FROM seqs),
      kmers AS (SELECT DISTINCT seq_id, substr(run, i, {K}) AS kmer
                FROM (SELECT *, unnest(generate_series(1, length(run) - {K - 1})) AS i FROM runs))"""

_SUMMARY_SQL = """count(*) AS n_kmers, min(kmer) AS "first", max(kmer) AS "last",
        sum(('0x' || substr(md5(kmer), 1, 10))::BIGINT)::BIGINT AS digest"""


def _horner_sql(base: int) -> str:
    h = "0::BIGINT"
    for i in range(1, K + 1):
        h = f"(({h}) * {base} + ascii(kmer[{i}])) % {PRIME}"
    return h


_CELLS_SQL = f"""{_SEQ_SQL},
      words AS (SELECT DISTINCT kmer FROM kmers),
      hashed AS (SELECT kmer, ((({_horner_sql(31)}) % 64) * 64 + ({_horner_sql(37)}) % 64) * 64
                   + ({_horner_sql(41)}) % 64 AS cell FROM words),
      seq_cells AS (SELECT DISTINCT seq_id AS set_id, cell::BIGINT AS cell
                    FROM kmers JOIN hashed USING (kmer))"""


def _reduce_sql(base: int) -> str:
    return (
        f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), "
        f"lambda c: ascii(c)::BIGINT)), lambda h, c: (h * {base} + c) % {PRIME})"
    )


_ANCHOR_SQL = f"""WITH {_CELLS_SQL}, {minima_sql('seq_cells', 32)},
      own AS (SELECT cell FROM seq_cells WHERE set_id = 0),
      counted AS (SELECT set_id, count(*) AS n, count(own.cell) AS inter
                  FROM seq_cells LEFT JOIN own USING (cell) GROUP BY 1),
      filled AS (SELECT d.doc_id AS set_id, p.plane, coalesce(b.m.c, 0) AS c
                 FROM documents d CROSS JOIN planes p
                 LEFT JOIN best b ON b.set_id = d.doc_id AND b.plane = p.plane),
      ests AS (SELECT y.set_id, avg((x.c = y.c)::INT) AS est FROM filled x JOIN filled y
               ON x.set_id = 0 AND y.set_id <> 0 AND x.plane = y.plane GROUP BY 1),
      valued AS (SELECT e.set_id, est,
                   coalesce(inter::DOUBLE / (n + (SELECT count(*) FROM own) - inter), 0.0) AS j
                 FROM ests e LEFT JOIN counted c ON c.set_id = e.set_id)
      SELECT set_id, '0 ↔ ' || set_id AS pair, 'classic' AS method, round(j, 9) AS exact, est,
             round(abs(est - j), 9) AS error,
             CASE WHEN j > 0.5 THEN 'HIGH' WHEN j > 0.2 THEN 'MED' ELSE 'LOW' END AS similarity
      FROM valued"""

_FAMILY_CELLS_SQL = _CELLS_SQL.replace("% 64", "% 32").replace("* 64", "* 32")


def _estimates_sql(best: str, method: str, planes: int) -> str:
    return f"""
      SELECT y.doc_id AS set_id, '{method}' AS method, avg((coalesce(a.m.c, 0) = coalesce(b.m.c, 0))::INT) AS est
      FROM documents y CROSS JOIN range({planes}) p(plane)
      LEFT JOIN {best} a ON a.set_id = 0 AND a.plane = p.plane
      LEFT JOIN {best} b ON b.set_id = y.doc_id AND b.plane = p.plane
      WHERE y.doc_id <> 0 GROUP BY 1"""


_FAMILIES_SQL = f"""WITH {_FAMILY_CELLS_SQL}, {minima_sql('seq_cells', 32)},
      {kron_minima_sql('seq_cells', 16, FAMILY_SHAPE)}, {tt_minima_sql('seq_cells', 8, FAMILY_SHAPE, 2)},
      own AS (SELECT cell FROM seq_cells WHERE set_id = 0),
      counted AS (SELECT set_id, count(*) AS n, count(own.cell) AS inter
                  FROM seq_cells LEFT JOIN own USING (cell) GROUP BY 1),
      ests AS ({" UNION ALL ".join(_estimates_sql(*f) for f in (("best", "classic", 32), ("kron_best", "kron", 16), ("tt_best", "tt", 8)))}),
      errors AS (SELECT method, abs(est - coalesce(inter::DOUBLE / (n + (SELECT count(*) FROM own) - inter), 0.0)) AS error
                 FROM ests LEFT JOIN counted USING (set_id))
      SELECT method, count(*) AS n_pairs, round(avg(error), 6) AS mae, round(max(error), 6) AS max_error
      FROM errors GROUP BY 1"""

QUERIES = {
    "kmer_sets": kmer_sets,
    "kmer_table_short": kmer_table_short,
    "sequence_profile": profile,
    "poly_hash_cells": poly_hash_cells,
    "poly_hash": poly_hash_values,
    "alphabet_check": alphabet_check,
    "fasta_scan": fasta_scan,
    "fasta_pieces": fasta_pieces,
    "sequence_similarity": sequence_anchor,
    "long_sequence_similarity": long_sequence_anchor,
    "sequence_similarity_families": sequence_anchor_all,
}

SQL = {
    "kmer_sets": f"""WITH {_SEQ_SQL} SELECT seq_id, {_SUMMARY_SQL} FROM kmers GROUP BY 1""",
    "fasta_pieces": f"""WITH {_SEQ_SQL.replace(_TEXT_SQL, _LETTERS_SQL)},
      found AS (SELECT seq_id, {_SUMMARY_SQL} FROM kmers GROUP BY 1)
      SELECT 'doc ' || seq_id AS header, length(seq) AS n_letters, coalesce(n_kmers, 0) AS n_kmers, "first", "last",
             digest FROM seqs LEFT JOIN found USING (seq_id)""",
    "kmer_table_short": f"""WITH seqs AS (
        SELECT c_custkey AS seq_id, translate(c_mktsegment || c_name, '{LETTERS}', '{BASES}') AS seq
        FROM customer),
      cut AS (SELECT seq_id, substr(seq, i, 4) AS kmer
              FROM (SELECT *, unnest(generate_series(1, length(seq) - 3)) AS i FROM seqs))
      SELECT DISTINCT seq_id, kmer FROM cut WHERE regexp_full_match(kmer, '[ACGT]+')""",
    "sequence_profile": f"""WITH {_SEQ_SQL},
      counts AS (SELECT seq_id, count(*) AS n FROM kmers GROUP BY 1)
      SELECT seq_id, length(seq)::INTEGER AS n_letters, coalesce(n, 0) AS n_kmers
      FROM seqs LEFT JOIN counts USING (seq_id)""",
    "poly_hash_cells": f"""WITH {_CELLS_SQL},
      sums AS (SELECT set_id, count(*) AS n_cells, sum(cell)::BIGINT AS sum_cells,
                      sum(cell * cell % 1000003)::BIGINT AS sum_squares FROM seq_cells GROUP BY 1)
      SELECT doc_id AS set_id, coalesce(n_cells, 0) AS n_cells, coalesce(sum_cells, 0) AS sum_cells,
             coalesce(sum_squares, 0) AS sum_squares
      FROM documents LEFT JOIN sums ON set_id = doc_id""",
    "poly_hash": f"""SELECT p_partkey, {_reduce_sql(31)} AS h31, {_reduce_sql(37)} AS h37,
      {_reduce_sql(41)} AS h41 FROM part""",
    "alphabet_check": """WITH words AS (SELECT unnest(string_split(text, ' ')) AS word FROM documents)
      SELECT word, count(*) AS n FROM words WHERE regexp_full_match(word, '[ACGT]+') GROUP BY 1""",
    "fasta_scan": """WITH letters AS (
        SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM documents)
      SELECT 'doc ' || doc_id AS header, length(seq) AS n_letters, md5(seq) AS digest FROM letters""",
    "sequence_similarity": _ANCHOR_SQL,
    "sequence_similarity_families": _FAMILIES_SQL,
    "long_sequence_similarity": _ANCHOR_SQL.replace(_TEXT_SQL, _LETTERS_SQL),
}
