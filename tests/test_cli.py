import json

import pytest

from quarry import __version__
from quarry.__main__ import main


def test_commands(spark, tmp_path, capsys):
    main(["version"])
    assert capsys.readouterr().out.strip() == __version__
    main(["settings"])
    assert json.loads(capsys.readouterr().out)["retrieval"]["k"] == 5
    main(["check"])
    assert "pyspark: there" in capsys.readouterr().out
    (tmp_path / "a.txt").write_text("Rivers carry water to the sea. Fish live in rivers.")
    main(["index", str(tmp_path / "a.txt"), "--out", str(tmp_path / "index")])
    main(["query", "where do fish live", "--index", str(tmp_path / "index")])
    assert "Fish live in rivers." in capsys.readouterr().out
    chunk = spark.read.parquet(str(tmp_path / "index" / "rows")).first()["chunk_id"]
    (tmp_path / "eval.jsonl").write_text(json.dumps({"question": "fish in rivers", "relevant_docs": [chunk]}) + "\n")
    main(["benchmark", str(tmp_path / "eval.jsonl"), "--index", str(tmp_path / "index"), "-k", "1"])
    assert json.loads(capsys.readouterr().out)["recall"] == 1.0
    with pytest.raises(SystemExit):
        main(["other"])
