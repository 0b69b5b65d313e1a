import numpy as np
import pytest

from pairspin.__main__ import main
from pairspin.sources import fixtures as fx
from pairspin.sources import msa


def test_modes(spark, sf, tmp_path, capsys):
    at = lambda x: str(tmp_path / x)
    msa.write_msa(fx.msa_b(spark, sf).limit(200), at("m"), "ABCD")
    main(["weights", "0.4", at("m"), at("w"), "--alpha", "ABCD"])
    main(["marginals", at("m"), at("f.npy"), "--alpha", "ABCD", "--weights", at("w")])
    assert np.allclose(np.load(at("f.npy")).sum(1), 1, atol=1e-5)
    main(["pseudocount", "constant", at("f.npy"), at("pc"), "--pc", "0.01"])
    main(["infer", at("pc"), at("fit"), "--nwalkers", "500", "--mcsteps", "1", "--newtonsteps", "3", "--equiltime", "16"])
    assert '"ssr"' in capsys.readouterr().out
    j = at("fit/run_00/couplings")
    main(["gauge", "fieldlessEven", j, at("even.npy")])
    main(["energies", at("m"), j, at("e"), "--alpha", "ABCD"])
    assert spark.read.parquet(at("e")).count() == 200
    main(["score", "fb", at("pc"), at("s"), "--couplings", j, "--matrix", at("s.bin")])
    assert np.fromfile(at("s.bin"), "f4").shape == (144,)
    main(["gen", j, at("gen"), "--nwalkers", "300", "--equiltime", "8"])
    assert spark.read.parquet(at("gen/walkers")).count() == 300
    main(["gen", at("fit/run_00"), at("cold"), "--nwalkers", "300", "--equiltime", "8", "--tempering", "1,0.5,0.2", "--swapevery", "4", "--ownpositions", "--trackequil", "4", "--tracked", "E"])
    assert spark.read.parquet(at("cold/walkers")).count() == 100 and spark.read.parquet(at("cold/equilibration/step_4/energies")).count() == 300
    main(["infer", at("pc"), at("fit2"), "--nwalkers", "200", "--mcsteps", "1", "--newtonsteps", "2", "--equiltime", "8", "--couplings", at("fit/run_00"), "--seqs", at("m"), "--alpha", "ABCD", "--preopt", "--reseed", "msa"])
    assert spark.read.parquet(at("fit2/preopt/walkers")).count() == 200
    for more in (["--seqs", at("m")], ["--seedseq", "ABCDABCDABCD"]):
        main(["gen", j, at("from"), "--nwalkers", "50", "--equiltime", "0", "--alpha", "ABCD", *more])
        assert spark.read.parquet(at("from/walkers")).select("seq").distinct().count() == (1 if "--seedseq" in more else 50)
    main(["infer", at("pc"), at("fit3"), "--nwalkers", "100", "--mcsteps", "1", "--newtonsteps", "2", "--newtondelta", "8", "--fracneff", "0.5", "--minequil", "8", "--maxequil", "64", "--reg", "SCADddE:0.05"])
    spark.read.parquet(at("w")).limit(150).write.parquet(at("w150"))
    with pytest.raises(Exception, match="no weight for sequence"):
        main(["marginals", at("m"), at("f150"), "--alpha", "ABCD", "--weights", at("w150")])
    main(["benchmark", j, "--nwalkers", "100", "--nsteps", "8"])
    assert "mc_steps_per_second" in capsys.readouterr().out
    (tmp_path / "map").write_text("ALPHA2 AB CD\n" * 12)
    main(["mapseqs", at("map"), at("m"), at("small"), "--alpha", "ABCD"])
    assert msa.load_msa(spark, at("small"), "AB").count() == 200
    main(["reduce", at("pc"), at("groups"), "--alpha", "ABCD", "--q", "3"])
    main(["subsample", at("m"), at("few"), "--alpha", "ABCD"])
    assert 0 < msa.load_msa(spark, at("few"), "ABCD").count() < 200
