"""Reading and writing alignments, Stockholm text and model arrays.

Flat text: optional ``#PARAM {json}`` and other ``#`` lines, then ``[id and blanks]sequence`` rows of one width; ``//`` and empty lines are
skipped.  Reading is a Spark text scan and a projection, after one that counts lines; rows are numbered by line.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.alphabet import length_of, letters
from ..functions.ship import ship


def _files(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(path, whether it is bzip2 by its first bytes) of each file of a file, folder or pattern, by name; only those bytes are read."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found: list[tuple[str, bool]] = []
    waiting = [*(store.globStatus(top) or [])]
    while waiting:
        status = waiting.pop()
        name = status.getPath().getName()
        if status.isDirectory():
            waiting += store.listStatus(status.getPath())
        elif not name.startswith(("_", ".")):
            stream = store.open(status.getPath())
            found.append((status.getPath().toString(), [stream.read() for _ in range(3)] == [*b"BZh"]))
            stream.close()
    return sorted(found)


def _unpacked(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, at, value) of bzip2 files without the extension; one task a file, as such a file can't be split."""
    import bz2

    ship(spark)

    def unpack(batches):
        import pyarrow as pa

        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, rest, left = 0, b"", content
                while left:  # a file may hold several streams
                    stream = bz2.BZ2Decompressor()
                    while left and not stream.eof:
                        rest += stream.decompress(left[: 1 << 20])
                        left = stream.unused_data + left[1 << 20 :] if stream.eof else left[1 << 20 :]
                        *rows, rest = rest.split(b"\n")
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(range(at, at + len(rows)), pa.int64()), pa.array([r.decode() for r in rows])], names=["file", "at", "value"])
                            at += len(rows)
                if rest:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int64()), pa.array([rest.decode()])], names=["file", "at", "value"])

    return spark.read.format("binaryFile").load(files).select("path", "content").mapInArrow(unpack, "file string, at long, value string")


def all_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, value) of every line of a text file or folder, header lines too; bzip2 is recognised by its first bytes, whatever the name.

    Lines are numbered from 0 through the files in order of their names, however Spark splits them: a first scan counts
    the lines of each split, and a row a split tells where its numbers begin.
    """
    files = _files(spark, path)
    packed = [name for name, bz in files if bz and not name.endswith(".bz2")]
    plain = [name for name, _ in files if name not in set(packed)]
    if not files:
        return spark.createDataFrame([], "seq_id long, value string")
    parts = []
    if plain:
        parts.append(spark.read.text(plain).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"))
    if packed:
        parts.append(_unpacked(spark, packed).select("file", F.lit(0).cast("long").alias("block"), "at", "value"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    splits = out.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    begins = splits.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return out.join(F.broadcast(begins), ["file", "block"]).select((F.col("at") + F.col("shift")).alias("seq_id"), "value")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, value) of the rows of a text file or folder, numbered by line; see ``all_lines``."""
    rows = all_lines(spark, path).withColumn("value", F.regexp_replace("value", "\r$", ""))
    return rows.where(~F.col("value").startswith("#") & (F.trim("value") != "") & (F.trim("value") != "//"))


def headers(spark: SparkSession, path: str, start: str = "#", most: int = 100) -> list[str]:
    """The first ``most`` lines that begin with ``start``, packed files' too."""
    return [r.value for r in all_lines(spark, path).where(F.col("value").startswith(start)).orderBy("seq_id").limit(most).collect()]


def header_alphabet(spark: SparkSession, path: str) -> str | None:
    """The alphabet that the first ``#PARAM`` line names, if any."""
    for line in headers(spark, path, "#PARAM", 1):
        return json.loads(line[6:].strip()).get("alpha")
    return None


def encoded(sequence: Column, alphabet: str, where: Column | None = None) -> Column:
    """array<int> of letter numbers; other letters raise an error that names the row and place."""
    place = F.coalesce(where.cast("string") if where is not None else F.lit("?"), F.lit("?"))
    chars = F.split(sequence, "")
    table = F.create_map(*(x for n, c in enumerate(alphabet) for x in (F.lit(c), F.lit(n))))
    return F.transform(chars, lambda c, p: F.coalesce(F.try_element_at(table, c), F.raise_error(F.concat(F.lit("letter "), c, F.lit(" of row "), place, F.lit(" at position "), p.cast("string"), F.lit(" is not in the alphabet"))).cast("int")))


def load_msa(spark: SparkSession, path: str, alphabet: str | None = None, count: int | None = None, check: bool = True) -> DataFrame:
    """(seq_id, id, seq).  Rows of another length than the first one's raise an error; ``count`` keeps the first rows."""
    name = alphabet or header_alphabet(spark, path)
    if name is None:
        raise ValueError("no alphabet given, and none in the file")
    rows = lines(spark, path)
    first = rows.orderBy("seq_id").limit(1).collect()
    if not first:
        return spark.createDataFrame([], "seq_id long, id string, seq array<int>")
    width = len(first[0].value) - (first[0].value.rfind(" ") + 1)
    lead = first[0].value.rfind(" ") + 1
    if count is not None:
        rows = rows.orderBy("seq_id").limit(count)
    whole = F.length("value") == lead + width
    spaced = (F.lit(lead == 0)) | (F.substring("value", lead, 1) == " ")
    if check:
        bad = F.raise_error(F.concat(F.lit("bad row: "), F.col("value"))).cast("string")
        rows = rows.withColumn("value", F.when(whole & spaced, F.col("value")).otherwise(bad))
    else:
        rows = rows.where(whole & spaced)
    ident = F.trim(F.substring("value", 1, lead)) if lead else F.lit(None).cast("string")
    return rows.select("seq_id", ident.alias("id"), encoded(F.substring("value", lead + 1, width), letters(name), F.col("seq_id")).alias("seq"))


def bad_rows(spark: SparkSession, path: str, alphabet: str) -> DataFrame:
    """(seq_id, value) of rows that ``load_msa`` would refuse."""
    rows = lines(spark, path)
    first = rows.orderBy("seq_id").limit(1).collect()
    if not first:
        return rows
    lead, size = first[0].value.rfind(" ") + 1, len(first[0].value)
    rest = F.translate(F.expr(f"substr(value, {lead + 1})"), letters(alphabet), "")
    spaced = F.lit(True) if lead == 0 else F.substring("value", lead, 1) == " "
    return rows.where((F.length("value") != size) | (F.length(rest) > 0) | ~spaced)


def decoded(alphabet: str) -> Column:
    """Text of the column seq."""
    table = F.array(*map(F.lit, alphabet))
    return F.concat_ws("", F.transform("seq", lambda x: F.get(table, x)))


def write_msa(msa: DataFrame, path: str, alphabet: str, param: dict | None = None, compress: bool = False) -> None:
    """Text in order of seq_id; ids are padded to one width.  With ``param`` the first line is a ``#PARAM`` header."""
    name = letters(alphabet)
    text = decoded(name)
    if "id" in msa.columns:
        width = msa.agg(F.max(F.length("id"))).first()[0]
        if width:
            text = F.concat(F.rpad(F.coalesce("id", F.lit("")), width + 1, " "), text)
    rows = msa.orderBy("seq_id").select(text.alias("value"))
    if param is not None:
        head = msa.sparkSession.createDataFrame([("#PARAM " + json.dumps(param),)], "value string")
        rows = head.coalesce(1).union(rows)
    rows.write.text(path, compression="bzip2" if compress else "none")


def stockholm(spark: SparkSession, path: str, ambiguous: str = "BJOUXZ") -> DataFrame:
    """(seq_id, id, text): last field of each row without insertions (lower case and dots); rows with ambiguous letters go."""
    return clean_stockholm(lines(spark, path), ambiguous)


def clean_stockholm(rows: DataFrame, ambiguous: str = "BJOUXZ") -> DataFrame:
    fields = F.split(F.trim("value"), r"\s+")
    x = rows.select("seq_id", F.element_at(fields, 1).alias("id"), F.regexp_replace(F.element_at(fields, -1), "[a-z.]", "").alias("text"))
    return x.where(~F.col("text").rlike(f"[{ambiguous}]"))


def map_msa(msa: DataFrame, f, schema: str) -> DataFrame:
    """``f`` (iterator of pandas frames -> the same) over batches."""
    return msa.mapInPandas(f, schema)


def reduce_msa(msa: DataFrame, *aggregates: Column) -> DataFrame:
    """One row of aggregates over the alignment."""
    return msa.agg(*aggregates)


def load_pairs(spark: SparkSession, path: str, value: str = "f") -> DataFrame:
    """(i, j, a, b, value) from a .npy array or text matrix of a row a pair and q^2 columns."""
    try:
        x = np.load(path)
    except ValueError:
        x = np.loadtxt(path, ndmin=2)
    length, q = length_of(len(x)), round(x.shape[1] ** 0.5)
    if q * q != x.shape[1]:
        raise ValueError("the number of columns is no square")
    import pandas as pd

    i, j = np.triu_indices(length, 1)
    a, b = np.divmod(np.arange(q * q), q)
    frame = pd.DataFrame({"i": np.repeat(i, q * q), "j": np.repeat(j, q * q), "a": np.tile(a, len(i)), "b": np.tile(b, len(i))}).astype("int32")
    return spark.createDataFrame(frame.assign(**{value: x.astype(np.float64).ravel()}))


def save_pairs(pairs: DataFrame, path: str, value: str = "f", dtype: str = "f4") -> None:
    """The array that ``load_pairs`` reads; model parameters, so one file."""
    t = pairs.select("i", "j", "a", "b", value).orderBy("i", "j", "a", "b").toArrow()
    q = int(t.column(2).to_numpy().max()) + 1
    np.save(path, t.column(4).to_numpy().reshape(-1, q * q).astype(dtype))


def load_seed(path_or_text: str, alphabet: str) -> list[int]:
    """A sequence given as letters, or the first line of a file."""
    import os

    text = path_or_text
    if os.path.exists(text):
        with open(text) as f:
            text = f.readline().strip()
    return [letters(alphabet).index(c) for c in text]


def save_matrix(scores: DataFrame, length: int, path: str, value: str = "score") -> None:
    """Square matrix of pair scores, last row first, as raw float32."""
    m = np.zeros((length, length), np.float32)
    for r in scores.select("i", "j", value).collect():
        m[r.i, r.j] = m[r.j, r.i] = r[2]
    m[::-1].tofile(path)
