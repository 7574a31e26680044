import json

from quern import cli


def run(spark, capsys, *args):
    cli.main(list(args), spark)
    return [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]


def test_commands(spark, capsys, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("# Tea\n\nGreen tea is served at four.")
    spark.conf.set("quern.embedding_dim", "16")
    try:
        store = f"file://{tmp_path}/store"
        assert run(spark, capsys, "index", "--store", store, "--docs", f"file://{docs}")[0]["chunks_added"] == 1
        assert run(spark, capsys, "query", "--store", store, "when is green tea served")[0]["sources"][0]["source"] == "a.md"
        (tmp_path / "q.json").write_text(json.dumps([{"id": "a", "question": "green tea served at four", "ground_truth_keywords": ["four"], "must_cite": "a.md"}]))
        assert {r["metric"]: r.get("value") for r in run(spark, capsys, "evaluate", "--store", store, str(tmp_path / "q.json"), "--save", f"{tmp_path}/runs")}["hit_at_1"] == 1.0
        assert run(spark, capsys, "diagnose", "--store", store)[0]["n"] == 1
    finally:
        spark.conf.unset("quern.embedding_dim")
    table = f"{tmp_path}/memory"
    run(spark, capsys, "memory", "add", "likes tea", "--table", table, "--user", "u")
    found = run(spark, capsys, "memory", "search", "tea", "--table", table, "--user", "u")
    assert found[0]["content"] == "likes tea"
    assert run(spark, capsys, "memory", "delete", found[0]["id"], "--table", table) == [{"deleted": True}]
    assert run(spark, capsys, "memory", "list", "--table", table, "--user", "u") == []
    (tmp_path / "p.json").write_text(json.dumps({"question": "q", "type": "positive", "run": 0, "answer": "the key", "confidence": 0.9, "expect_reject": False, "keywords": ["key"]}))
    assert run(spark, capsys, "probe", str(tmp_path / "p.json"))[1]["delivered"] == 1
