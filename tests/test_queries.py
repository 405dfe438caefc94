import __spark_entry__ as entry


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    unchecked = {q for q in set(entry.queries()) - set(entry.oracle_sql())
                 if q != "pipeline" and not q.startswith("op")}
    assert unchecked == {
        "scan_result_json", "secrets_report_json", "webhook_payload", "markdown_report"}


def test_entry_runs(spark):
    rows = entry.entry(spark)
    assert rows.columns[:5] == ["timestamp", "repo_path", "branch", "commit_hash", "file"]
    assert rows.where("file is null").count() == 50
