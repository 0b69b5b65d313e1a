"""Command line: ``python -m pairspin MODE ...``; tables are Parquet folders, or .npy arrays where the name ends so."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.alphabet import letters
from .operators import filters, gauge, marginals, reduction, sampling, scores, similarity
from .plans import infer
from .sources import msa


def read_pairs(spark: SparkSession, path: str, value: str) -> DataFrame:
    return msa.load_pairs(spark, path, value) if path.endswith((".npy", ".txt")) else spark.read.parquet(path)


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """Couplings of a table, an array, or a folder of a round (its ``couplings``)."""
    return read_pairs(spark, f"{path}/couplings" if infer.exists(spark, f"{path}/couplings") else path, "cpl")


def betas(text: str) -> tuple[float, ...]:
    return tuple(float(x) for x in text.split(","))


def write_table(df: DataFrame, path: str, value: str) -> None:
    if path.endswith(".npy"):
        msa.save_pairs(df, path, value)
    else:
        df.write.mode("overwrite").parquet(path)


def shape(pairs: DataFrame) -> tuple[int, int]:
    r = pairs.agg(F.max("j"), F.max("a")).first()
    return r[0] + 1, r[1] + 1


def weighted(spark: SparkSession, args) -> tuple[DataFrame, int, int]:
    """The alignment with weights, if any are given, its length and number of letters."""
    m = msa.load_msa(spark, args.seqs, args.alpha)
    length, q = len(m.first().seq), len(letters(args.alpha))
    if args.weights:
        w = spark.read.parquet(args.weights).select(F.col("key").cast("long").alias("seq_id"), F.col("weight").alias("w"))
        # a sequence without a weight is an error, not a sequence less
        m = m.join(w, "seq_id", "left").withColumn("w", F.when(F.col("w").isNull(), F.raise_error(F.concat(F.lit("no weight for sequence "), F.col("seq_id"))).cast("double")).otherwise(F.col("w")))
    return m, length, q


def sampling_options(args) -> dict:
    return {"tempering": args.tempering, "swaps": args.nswaps, "swap_every": args.swapevery, "track": args.trackequil, "tracked": tuple(args.tracked.split(",")), "own_positions": args.ownpositions}


def run(spark: SparkSession, args) -> None:
    mode = args.mode
    if mode == "infer":
        target = read_pairs(spark, args.bimarg, "f")
        length, q = shape(target)
        o = infer.Options(walkers=args.nwalkers, rounds=args.mcsteps, newton_steps=args.newtonsteps, gamma=args.gamma, damping=args.damping, regulariser=args.reg, reseed=args.reseed, newton_delta=args.newtondelta, keep_size=args.fracneff, min_equilibration=args.minequil, max_equilibration=args.maxequil, equilibration=args.equiltime, beta=args.beta, seed=args.seed, start=args.init, preopt=args.preopt, **sampling_options(args))
        seqs = msa.load_msa(spark, args.seqs, args.alpha) if args.seqs else None
        fit = infer.fit(spark, target, length, q, o, args.out, seqs, read_model(spark, args.couplings) if args.couplings else None)
        for state in fit.log:
            print(json.dumps(state))
    elif mode == "gen":
        j = read_model(spark, args.couplings)
        length, q = shape(j)
        o = infer.Options(walkers=args.nwalkers, beta=args.beta, seed=args.seed, **sampling_options(args))
        if args.seedseq:
            start = infer.with_betas(filters.tiled(spark, msa.load_seed(args.seedseq, args.alpha), o.walkers), o)
        else:
            first = msa.load_msa(spark, args.seqs, args.alpha) if args.seqs else None
            start = infer.reseeded(spark, None, "msa" if args.seqs else "uniform", o, [[1 / q] * q] * length, 0, first)
        w = infer.equilibrate(spark, start, scores.coupling_array(j, length, q), args.seed, args.equiltime, o=o, folder=f"{args.out}/equilibration")
        w = infer.coldest(w) if o.tempering else w
        w.write.mode("overwrite").parquet(f"{args.out}/walkers")
        write_table(marginals.bimarg(w, length, q), f"{args.out}/bimarg", "f")
    elif mode == "energies":
        j = read_pairs(spark, args.couplings, "cpl")
        length, q = shape(j)
        scores.energies(msa.load_msa(spark, args.seqs, args.alpha), j, length, q).write.mode("overwrite").parquet(args.out)
    elif mode == "subseq":
        j = read_pairs(spark, args.couplings, "cpl")
        length, q = shape(j)
        fixed = [int(x) for x in args.fixpos.split(",")]
        found = sampling.subsequence_logfreq(msa.load_msa(spark, args.subseqs, args.alpha), msa.load_msa(spark, args.seqs, args.alpha), fixed, scores.coupling_array(j, length, q))
        found.write.mode("overwrite").parquet(args.out)
    elif mode == "benchmark":
        j = read_pairs(spark, args.couplings, "cpl")
        length, q = shape(j)
        start = sampling.uniform_sequences(spark, args.nwalkers, length, q, args.seed).select(F.col("seq_id").alias("walker_id"), "seq", F.lit(1.0).alias("beta"))
        table = scores.coupling_array(j, length, q)
        for steps in (8, args.nsteps):  # the first warms up
            t = time.perf_counter()
            sampling.metropolis(start, table, steps, args.seed).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - t
        print(json.dumps({"mc_steps_per_second": round(args.nwalkers * args.nsteps / took)}))
    elif mode == "marginals":
        m, length, q = weighted(spark, args)
        w = "w" if args.weights else None
        write_table(marginals.unimarg(m, length, q, w) if args.uni else marginals.bimarg(m, length, q, w), args.out, "f")
    elif mode == "weights":
        m, length, q = weighted(spark, args)
        similarity.phylo_weights(similarity.single(m), length, q, args.sim).write.mode("overwrite").parquet(args.out)
    elif mode == "subsample":
        m, length, q = weighted(spark, args)
        kept = similarity.subsample(m, length, q, args.share, args.seed).orderBy("place")
        msa.write_msa(kept.select(F.row_number().over(_order("place")).cast("long").alias("seq_id"), "seq"), args.out, args.alpha)
    elif mode == "pseudocount":
        ff = read_pairs(spark, args.bimarg, "f")
        q = shape(ff)[1]
        done = {
            "constant": lambda: marginals.pc_constant(ff, *args.pc),
            "jeffreys": lambda: marginals.pc_mutation(ff, *args.pc, q),
            "bayes": lambda: marginals.pc_mutation(ff, *args.pc, q, "bayes"),
            "unijmix": lambda: marginals.pc_unijmix(ff, *args.pc, q),
            "meanfield": lambda: marginals.pc_meanfield(ff, *args.pc, q),
            "test": lambda: marginals.pc_test(ff, *args.pc, q),
        }[args.kind]()
        write_table(done, args.out, "f")
    elif mode == "preregularize":
        ff = read_pairs(spark, args.bimarg, "f")
        write_table(marginals.pre_regularize(marginals.pc_constant(ff, args.pseudocount), args.n), args.out, "f")
    elif mode == "gauge":
        j = read_pairs(spark, args.couplings, "cpl")
        length, q = shape(j)
        h = spark.read.parquet(args.fields) if args.fields else gauge.no_fields(j, length, q)
        if args.kind in ("zero", "zeroJ"):
            h, j = (gauge.zero if args.kind == "zero" else gauge.zero_j)(h, j, length)
            h.write.mode("overwrite").parquet(args.out + "_fields")
        else:
            j = gauge.fieldless(h, j) if args.kind == "fieldless" else gauge.fieldless_even(h, j, length)
        write_table(j.select("i", "j", "a", "b", "cpl"), args.out, "cpl")
    elif mode == "score":
        ff = read_pairs(spark, args.bimarg, "f")
        j = read_pairs(spark, args.couplings, "cpl") if args.couplings else None
        length, q = shape(ff)
        found = scores.score(args.kind, ff, j, q, args.pseudocount)
        found.write.mode("overwrite").parquet(args.out)
        if args.matrix:
            msa.save_matrix(found, length, args.matrix)
    elif mode == "reduce":
        ff = read_pairs(spark, args.bimarg, "f")
        groups, log = reduction.reduce_alphabets(ff, letters(args.alpha), args.q)
        reduction.groups_table(spark, groups).write.mode("overwrite").parquet(args.out)
        for line in log:
            print(*line)
    elif mode in ("mapseqs", "mapbimarg"):
        with open(args.map) as f:
            groups = filters.parse_map(f.read(), letters(args.alpha))
        q = len(letters(args.alpha))
        if mode == "mapseqs":
            small = filters.mapped_sequences(msa.load_msa(spark, args.seqs, args.alpha), groups, q)
            msa.write_msa(small, args.out, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[: max(map(len, groups))])
        else:
            write_table(filters.mapped_bimarg(read_pairs(spark, args.bimarg, "f"), groups, q), args.out, "f")
    elif mode == "stockholm":
        rows = msa.stockholm(spark, args.seqs)
        rows.orderBy("seq_id").select("text").write.mode("overwrite").text(args.out)


def _order(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pairspin", description=__doc__)
    modes = p.add_subparsers(dest="mode", required=True)
    seqs, alpha, pairs, model, out = ("seqs",), ("--alpha",), ("bimarg",), ("couplings",), ("out",)

    def mode(name: str, *args: tuple) -> argparse.ArgumentParser:
        m = modes.add_parser(name)
        for a in args:
            m.add_argument(*a, **({"default": "protgap"} if a == alpha else {}))
        return m

    walkers = {"--nwalkers": (int, 1 << 15), "--beta": (float, None), "--seed": (int, 0), "--equiltime": (int, None)}

    def options(m: argparse.ArgumentParser, of: dict) -> None:
        for name, (kind, default) in of.items():
            m.add_argument(name, type=kind, default=default)

    d = infer.Options()
    chains = {"--tempering": (betas, None), "--nswaps": (int, d.swaps), "--swapevery": (int, d.swap_every), "--trackequil": (int, d.track), "--tracked": (str, ",".join(d.tracked))}
    m = mode("infer", pairs, out, alpha, ("--seqs",))
    m.add_argument("--init", choices=["uniform", "independent"], default=d.start)
    m.add_argument("--preopt", action="store_true")
    m.add_argument("--ownpositions", action="store_true")
    options(m, walkers | chains | {"--mcsteps": (int, d.rounds), "--newtonsteps": (int, d.newton_steps), "--gamma": (float, d.gamma), "--damping": (float, d.damping), "--reg": (str, None), "--newtondelta": (int, d.newton_delta), "--fracneff": (float, d.keep_size), "--minequil": (int, d.min_equilibration), "--maxequil": (int, d.max_equilibration), "--reseed": (str, d.reseed), "--couplings": (str, None)})
    m = mode("gen", model, out, alpha, ("--seqs",), ("--seedseq",))
    m.add_argument("--ownpositions", action="store_true")
    options(m, walkers | chains)
    mode("energies", seqs, model, out, alpha)
    mode("subseq", ("fixpos",), seqs, ("subseqs",), model, out, alpha)
    options(mode("benchmark", model), walkers | {"--nsteps": (int, 2048)})
    mode("marginals", seqs, out, alpha, ("--weights",)).add_argument("--uni", action="store_true")
    mode("weights", ("sim",), seqs, out, alpha, ("--weights",))
    options(mode("subsample", seqs, out, alpha, ("--weights",)), {"--share": (float, 0.5), "--seed": (int, 0)})
    mode("pseudocount", ("kind",), pairs, out).add_argument("--pc", type=float, nargs="+", required=True)
    options(mode("preregularize", pairs, out), {"--n": (float, 1000.0), "--pseudocount": (float, 0.0)})
    mode("gauge", ("kind",), model, out, ("--fields",))
    options(mode("score", ("kind",), pairs, out, ("--couplings",), ("--matrix",)), {"--pseudocount": (float, 0.0)})
    options(mode("reduce", pairs, out, alpha), {"--q": (int, 2)})
    mode("mapseqs", ("map",), seqs, out, alpha)
    mode("mapbimarg", ("map",), pairs, out, alpha)
    mode("stockholm", seqs, out)
    return p


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    run(SparkSession.builder.appName("pairspin").getOrCreate(), args)


if __name__ == "__main__":
    main()
