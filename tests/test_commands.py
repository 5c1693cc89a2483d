"""The command line on a small synthetic dataset, end to end."""

import json

import pytest

from linkforge.__main__ import main
from linkforge.operators import decide as D
from linkforge.plans import commands as C
from linkforge.sources import synthetic


def test_commands_from_data_to_score(spark, tmp_path, capsys):
    data, bundle, out = (str(tmp_path / x) for x in ("synthetic", "bundle", "out"))
    C.synthesize(spark, data, 300)
    found = C.audit(spark, data)
    assert found["truth"][0]["records"] == 300 and {r["rule"]: r["n"] for r in found["findings"]}["unknown_target"] == 0
    report = C.train(spark, data, bundle, variant="v4all", features="core", model="sgd")
    assert report["assess"][0]["macro_f05"] > 0.7
    C.predict(spark, data, bundle, out, split="train")
    assert C.validate(spark, data, f"{out}/matches.tsv", split="train")["findings"] == []
    main(["score", "--data", data, "--lists", f"{out}/matches.tsv"])
    assert json.loads(capsys.readouterr().out)["evaluation"][0]["macro_f05"] > 0.7
    with pytest.raises(D.BadBundle):
        D.load_bundle(spark, bundle, variant="v2")
    assert C.diagnose(spark, data)["candidates"][0]["micro_candidate_recall"] > 0.9


def test_made_rows_are_the_same_on_any_partitions(spark, tmp_path):
    a, b = synthetic.generate(spark, 200, 7), synthetic.generate(spark, 200, 7)
    assert [sorted(map(str, x.collect())) for x in a] == [sorted(map(str, x.repartition(3).collect())) for x in b]
    with pytest.raises(ValueError, match="synthetic"):
        synthetic.write(spark, str(tmp_path / "plain"), 5)
