"""Sequences in pieces: any split of a file gives the records, letters and k-mers of the whole."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gridkin.operators.families import ClassicFamily, KronFamily
from gridkin.operators.sequences import piece_cells, piece_kmers, piece_records, sequence_sets
from gridkin.plans.sequences import long_sequence_similarity, sequence_similarity
from gridkin.sources.fasta import read_fasta_pieces


def parse(text):
    """(header, letters) by record; record 0 is what stands before the first header."""
    records = [[None, ""]]
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = line.strip()
        if line.startswith(">"):
            records.append([line[1:].strip(), ""])
        else:
            records[-1][1] += "".join(line.split()).upper()
    return {i: (h, s) for i, (h, s) in enumerate(records) if i or s}


def windows(seq, k):
    return {seq[i : i + k] for i in range(len(seq) - k + 1) if set(seq[i : i + k]) <= set("ACGT")}


def written(rng, records, width):
    out = []
    for i in range(records):
        out.append(f"{'  ' if i % 5 == 4 else ''}>rec {i} > x{' ' if i % 2 else ''}")
        seq = "".join(rng.choice(list("ACGTacgtNé"), int(rng.integers(0, 150)), p=[0.22, 0.22, 0.22, 0.22, 0.02, 0.02, 0.02, 0.02, 0.03, 0.01]))
        out += [seq[j : j + width] for j in range(0, len(seq), width)]
        out += ["", " ac gt "][: int(rng.integers(0, 3))]
    return "\n".join(out)


@pytest.fixture
def tiny_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "0")

    def read(n, *args):
        """Only the files themselves are cut so small, not what is stored of them."""
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        try:
            return read_fasta_pieces(spark, *args)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", kept["spark.sql.files.maxPartitionBytes"])

    yield read
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("split", "piece", "width"), [(57, 3, 11), (400, 16, 60), (29, 5, 4)])
def test_pieces_are_the_whole_files(spark, tmp_path, tiny_splits, split, piece, width):
    rng = np.random.default_rng(split)
    texts = {
        "a.fasta": written(rng, 4, width),
        "b.fasta": "acgta\ncgt\n\n" + written(rng, 2, width) + "\n",
        "c.fasta": written(rng, 3, width).replace("\n", "\r\n"),
        "d.fasta": ">only\n>two\n\n>three",
        "e.fasta": "\n\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    pieces = tiny_splits(split, str(tmp_path), piece)
    name = F.regexp_extract("file", "([^/]*)$", 1).alias("file")
    want = {(f, i): r for f, t in texts.items() for i, r in parse(t).items()}
    got = piece_records(pieces).select(name, "record", "header", "n_letters").collect()
    assert {(r.file, r.record): (r.header, r.n_letters) for r in got if r.record or r.n_letters} == {
        k: (h, len(s)) for k, (h, s) in want.items()
    }
    for k in (1, 5, 12):
        found = piece_kmers(pieces, k).select(name, "record", "kmer").collect()
        assert len(found) == len(set(found))
        assert {tuple(r) for r in found} == {(*at, w) for at, (_, s) in want.items() for w in windows(s, k)}


def test_one_long_record_is_work_for_several_tasks(spark, tmp_path, tiny_splits):
    rng = np.random.default_rng(0)
    seq = "".join(rng.choice(list("ACGT"), 1_000_000))
    (tmp_path / "long.fasta").write_text(">chr\n" + "\n".join(seq[i : i + 80] for i in range(0, len(seq), 80)))
    pieces = tiny_splits(100_000, str(tmp_path))
    assert pieces.select("block").distinct().count() >= 10
    assert pieces.rdd.getNumPartitions() > 1
    assert piece_records(pieces).first()["n_letters"] == len(seq)
    assert piece_kmers(pieces, 12).count() == len(windows(seq, 12))


def test_piece_cells_equal_whole_sequences(spark, tmp_path):
    rng = np.random.default_rng(1)
    seqs = ["".join(rng.choice(list("ACGT"), n)) for n in (500, 30, 5, 0)]
    rows = [(i, 0, p, s[a : a + 7].encode()) for i, s in enumerate(seqs) for p, a in enumerate(range(0, max(len(s), 1), 7))]
    pieces = spark.createDataFrame(rows, "seq_id long, block long, part long, seq binary")
    whole = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")
    cells = piece_cells(pieces, 6, (7, 5, 3), ["seq_id"])
    want = sequence_sets(whole, 6, (7, 5, 3)).select("set_id", F.explode("cells"))
    assert sorted(map(tuple, cells.collect())) == sorted(map(tuple, want.collect()))
    families = [ClassicFamily(16), KronFamily(16, 1, (7, 5, 3))]
    kwargs = {"kmer": 6, "shape": (7, 5, 3), "families": families}
    assert sorted(map(tuple, long_sequence_similarity(pieces, 0, **kwargs).collect())) == sorted(
        map(tuple, sequence_similarity(whole, 0, **kwargs).collect())
    )


@pytest.mark.parametrize("k", [1, 5, 12, 16, 31])
def test_numbered_kmers_are_in_the_order_of_their_letters(spark, k):
    """r04 F4."""
    rng = np.random.default_rng(k)
    seqs = ["".join(rng.choice(list("ACGTN"), n, p=[0.245] * 4 + [0.02])) for n in (700, 90, 31, 0)]
    rows = [(i, 0, p, s[a : a + 40].encode()) for i, s in enumerate(seqs) for p, a in enumerate(range(0, max(len(s), 1), 40))]
    pieces = spark.createDataFrame(rows, "seq_id long, block long, part long, seq binary")
    found = piece_kmers(pieces, k, ["seq_id"], numbered=True).collect()
    number = lambda w: sum("ACGT".index(c) * 4 ** (len(w) - 1 - i) for i, c in enumerate(w))
    assert sorted(map(tuple, found)) == sorted((i, w, number(w)) for i, s in enumerate(seqs) for w in windows(s, k))
    assert sorted((r.place, r.kmer) for r in found) == sorted(((r.place, r.kmer) for r in found), key=lambda x: x[1])


def test_long_kmers_have_no_number(spark):
    pieces = spark.createDataFrame([(1, 0, 0, b"ACGT" * 10)], "seq_id long, block long, part long, seq binary")
    assert piece_kmers(pieces, 33, ["seq_id"]).count() == 4
    with pytest.raises(ValueError):
        piece_kmers(pieces, 33, ["seq_id"], numbered=True)


def test_missing_files_are_named(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_fasta_pieces(spark, str(tmp_path / "none.fasta"))
