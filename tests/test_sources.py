import bz2

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairspin.functions.alphabet import letters, length_of, n_pairs, pair_number
from pairspin.operators import marginals
from pairspin.sources import fixtures as fx
from pairspin.sources import msa
from pairspin.streaming.bicounts import streaming_bicounts

ROWS = ["s1   ACGT", "s22  CCGT", "s3   AAAA"]


def test_reads_text(spark, tmp_path):
    p = tmp_path / "m.txt"
    p.write_text('#PARAM {"alpha": "ACGT"}\n# note\n' + "\n".join(ROWS) + "\n//")
    got = msa.load_msa(spark, str(p)).orderBy("seq_id").collect()
    assert [(r.id, r.seq) for r in got] == [("s1", [0, 1, 2, 3]), ("s22", [1, 1, 2, 3]), ("s3", [0, 0, 0, 0])]
    assert len(msa.load_msa(spark, str(p), count=2).collect()) == 2


def test_bzip2_by_content(spark, tmp_path):
    for name in ("m.txt", "m.bz2"):
        (tmp_path / name).write_bytes(bz2.compress("\n".join(ROWS).encode()))
        assert msa.load_msa(spark, str(tmp_path / name), "nuc").count() == 3


def test_folder_of_plain_and_packed_files(spark, tmp_path):
    """Files of both kinds are read, headers of packed ones too, and numbers follow names and lines whatever the splits."""
    head = '#PARAM {"alpha": "ACGT"}\n'
    (tmp_path / "a.txt").write_bytes(bz2.compress((head + "ACGT\nCCGT\n").encode()) + bz2.compress(b"GGGG"))
    (tmp_path / "b.txt").write_text("AAAA\n" * 2000 + "TTTT")
    (tmp_path / "c.txt.bz2").write_bytes(bz2.compress(b"TCGA\n"))
    (tmp_path / "_hidden").write_text("not read")
    assert msa.header_alphabet(spark, str(tmp_path)) == "ACGT"
    want = ["ACGT", "CCGT", "GGGG", *["AAAA"] * 2000, "TTTT", "TCGA"]
    for size in ("128m", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = msa.load_msa(spark, str(tmp_path)).withColumn("text", msa.decoded("ACGT")).orderBy("seq_id").collect()
        assert [(r.seq_id, r.text) for r in got] == [(k + 1, x) for k, x in enumerate(want)]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_bad_rows(spark, tmp_path):
    p = tmp_path / "m.txt"
    p.write_text("\n".join([*ROWS, "s4   ACG", "s5   ACGX"]))
    with pytest.raises(Exception, match="bad row|letter"):
        msa.load_msa(spark, str(p), "nuc").collect()
    assert sorted(r.value for r in msa.bad_rows(spark, str(p), "nuc").collect()) == ["s4   ACG", "s5   ACGX"]
    q = tmp_path / "n.txt"
    q.write_text("ACGT\nACXT")
    with pytest.raises(Exception, match="position 2"):
        msa.load_msa(spark, str(q), "nuc").collect()


def test_empty_file(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# nothing\n//\n")
    assert msa.load_msa(spark, str(tmp_path / "e.txt"), "nuc").count() == 0


@pytest.mark.parametrize("compress", [False, True])
def test_round_trip(spark, sf, tmp_path, compress):
    m = fx.msa_b(spark, sf).withColumn("id", F.concat(F.lit("v"), "seq_id"))
    msa.write_msa(m, str(tmp_path / "out"), "ABCD", None, compress)
    back = {r.id: r.seq for r in msa.load_msa(spark, str(tmp_path / "out"), "ABCD").collect()}
    assert back == {r.id: r.seq for r in m.collect()}


def test_stockholm(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# STOCKHOLM 1.0\nx/1-4  AC..gT-\ny/1-4  ACBGT-.\n//\n")
    assert [(r.id, r.text) for r in msa.stockholm(spark, str(tmp_path / "s.txt")).collect()] == [("x/1-4", "ACT-")]


def test_arrays(spark, sf, tmp_path):
    ff = marginals.bimarg(fx.msa_a(spark, sf), 6, 4)
    msa.save_pairs(ff, str(tmp_path / "f.npy"), dtype="f8")
    assert np.load(tmp_path / "f.npy").shape == (15, 16)
    both = msa.load_pairs(spark, str(tmp_path / "f.npy")).withColumnRenamed("f", "g").join(ff, ["i", "j", "a", "b"])
    assert both.agg(F.count("*"), F.max(F.abs(F.col("f") - F.col("g")))).first()[:] == (240, 0.0)
    msa.save_matrix(spark.createDataFrame([(0, 1, 0.5)], "i int, j int, score double"), 2, str(tmp_path / "m"))
    assert np.fromfile(tmp_path / "m", "f4").tolist() == [0.5, 0, 0, 0.5]


def test_seed(tmp_path):
    (tmp_path / "seed").write_text("ACGT\nrest")
    assert msa.load_seed(str(tmp_path / "seed"), "nuc") == msa.load_seed("ACGT", "nuc") == [0, 1, 2, 3]


def test_numbering():
    assert letters("charge") == "0+-" and letters("XYZ") == "XYZ"
    assert [length_of(n_pairs(k)) for k in (2, 3, 12, 232)] == [2, 3, 12, 232]
    assert [pair_number(i, j, 4) for i in range(4) for j in range(i + 1, 4)] == list(range(6))
    with pytest.raises(ValueError):
        length_of(5)


def test_streaming_counts(spark, sf, tmp_path):
    m = fx.msa_a(spark, sf).limit(500)
    m.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming_bicounts(stream, 6).writeStream.outputMode("complete").format("memory").queryName("bc").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r)[:4]: r.n for r in spark.table("bc").collect()}
    want = {tuple(r)[:4]: r.n for r in marginals.bicounts(spark.read.parquet(str(tmp_path / "in")), 6, 4).where("n > 0").collect()}
    assert got == want
