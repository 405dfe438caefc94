import math

import pytest
from pyspark.sql import functions as F

from wardlake.functions import text as tx
from wardlake.operators import secrets
from wardlake.rules import Rule, rules_from_table
from wardlake.sources.files import explode_lines

H = "0123456789abcdef0123456789abcdef"
POSITIVE = {
    "AWS_KEY": ('k = "AKIA' + "A1B2C3D4E5F6G7H8" + '"', 'k = "AKIA' + "a1b2c3d4e5f6g7h8" + '"'),
    "AWS_SECRET": (f'AWS_SECRET_access-key = "{H}{H[:8]}"', f'aws_secret_access_key = "{H}"'),
    "GITHUB_TOKEN": (f"gho_{H}{H[:4]}", f"ghx_{H}{H[:4]}"),
    "GITLAB_TOKEN": (f"glpat-{H[:20]}", f"glpat-{H[:19]}"),
    "PRIVATE_KEY": ("-----BEGIN EC " + "PRIVATE KEY-----", "-----BEGIN DSA " + "PRIVATE KEY-----"),
    "GENERIC_API_KEY": (f"API-KEY: {H[:20]}", f"api_key: {H[:19]}"),
    "PASSWORD": ('Password = "hunter2hunter"', 'password = "short"'),
    "DATABASE_URL": ("MySQL://u:p@h/db", "oracle://u:p@h/db"),
    "JWT_TOKEN": (f"eyJ{H}.eyJ{H}.{H}", f"eyJ{H}.abc{H}"),
    "BEARER_TOKEN": (f"bearer {H}.{H}.{H}", f"bearer {H}"),
    "STRIPE_KEY": (f"sk_live_{H[:24]}", f"sk_prod_{H[:24]}"),
    "TWILIO_KEY": (f"SK{H}", f"SK{H[:31]}"),
    "SENDGRID_KEY": (f"SG.{H[:22]}.{H}{H[:11]}", f"SG.{H[:22]}.{H}"),
    "MAILGUN_KEY": (f"key-{H}", f"key-{H[:31]}"),
    "SLACK_TOKEN": (f"xoxb-{H}", f"xoxz-{H}"),
    "DISCORD_TOKEN": (f"--M{H}.{H[:6]}.{H}", f"A{H}.{H[:6]}.{H}"),
    "GOOGLE_API_KEY": (f"AIza{H}abc", f"AIza{H}ab"),
    "AZURE_KEY": (f'azureKey="{H}{H[:12]}"', f'azureKey="{H}"'),
}


@pytest.mark.parametrize("unicode_space", [False, True])
def test_each_rule_hits_its_line_and_not_the_near_miss(spark, make_files, unicode_space):
    files = make_files(*((f"{t}{i}", line) for t, pair in POSITIVE.items()
                         for i, line in enumerate(pair)))
    rows = secrets.secret_candidates(explode_lines(files), unicode_space=unicode_space).collect()
    hit = {(r.path.split("/")[1], r.type) for r in rows}
    for name in POSITIVE:
        assert (f"{name}0", name) in hit
        assert (f"{name}1", name) not in hit


def test_discord_token_is_the_leftmost_one(make_files):
    long = f"abcM{H}.{H[:6]}.{H}xyz M{H}.{H[:6]}.{H}"
    got = secrets.secret_candidates(explode_lines(make_files(("a", long)))).collect()
    found = [r.match for r in got if r.type == "DISCORD_TOKEN"]
    assert found == [f"M{H}.{H[:6]}.{H}xyz"]


def test_case_folding_matches_unicode_simple_folding(make_files):
    line = 'paſſword = "hunter2hunter"'
    got = secrets.secret_candidates(explode_lines(make_files(("a", line)))).collect()
    assert [r.type for r in got] == ["PASSWORD"]


def test_entropy_and_masks(spark):
    row = spark.createDataFrame(
        [("aaaaaaaa", "sk_test_" + "1234567890" * 4, "short", "verylongsecretkey123456789", "é" * 5)],
        "a string, b string, c string, d string, e string").select(
        tx.shannon_entropy(F.col("a")).alias("a"), tx.shannon_entropy(F.col("b")).alias("b"),
        tx.mask_strict(F.col("c")).alias("c"), tx.mask_strict(F.col("d")).alias("d"),
        tx.mask_gate(F.col("c")).alias("g"), tx.mask_gate(F.col("d")).alias("h"),
        tx.shannon_entropy(F.col("e")).alias("e")).first()
    assert row.a == 0.0
    assert math.isclose(row.b, 3.7932958, abs_tol=1e-6)
    assert (row.c, row.d) == ("*****", "very" + "*" * 18 + "6789")
    assert (row.g, row.h) == ("***", "very...6789")
    assert row.e == 0.5  # five characters over ten bytes


def test_context_filters(make_files):
    key = 'k = "AKIA' + "A1B2C3D4E5F6G7H8" + '"'
    files = make_files(
        ("ok.py", key), ("comment.py", "  # " + key), ("doc.md", key), ("x_test.go", key),
        ("y_test.go", f"key-{H}"), ("stripe.py", f"sk_test_{H}"),
        ("p1.py", 'var password = "hunter2hunter"'), ("p2.py", "password: hunter2hunter"),
        ("build/x.py", key), ("readme.py", 'tok = "AKIA' + "B1B2C3D4E5F6G7H8" + '" readme'))
    got = {(r.file, r.type) for r in secrets.secrets_gate(files).collect()}
    # The key is the same in ok.py and x_test.go: the first in walk order stays.
    assert got == {("ok.py", "AWS_KEY"), ("readme.py", "AWS_KEY")}
    strict = {r.file for r in secrets.secrets_strict(files).collect()}
    assert {"ok.py", "comment.py", "doc.md", "p1.py", "p2.py"} <= strict
    assert not {"readme.py", "stripe.py", "build/x.py"} & strict


def test_dedup_scope_and_walk_order(make_files):
    key = 'k = "AKIA' + "A1B2C3D4E5F6G7H8" + '"'
    files = make_files(("a-b/f.py", key), ("a/b.py", key + "\n" + key))
    gate = secrets.secrets_gate(files).collect()
    assert [(r.file, r.line) for r in gate] == [("a/b.py", 1)]
    strict = sorted((r.file, r.line) for r in secrets.secrets_strict(files).collect())
    assert strict == [("a-b/f.py", 1), ("a/b.py", 1)]


def test_confidence_keeps_the_order_of_additions(make_files):
    # 0.5 + 0.2 + 0.1 = 0.7999999999999999
    files = make_files(("a.py", "token: hunter2"), ("b.py", "password=abcdefghij"))
    row = [r for r in secrets.secrets_gate(files).collect() if r.type == "PASSWORD"][0]
    assert row.confidence == 0.5 + 0.2 + 0.1 == 0.7999999999999999


def test_strict_profile_drops_carriage_return_and_invalid_utf8(spark, make_files):
    files = make_files(("a.py", "password = abcdefgh\r\nx"))
    assert secrets.secrets_strict(files).first().match == "pass" + "*" * 11 + "efgh"
    bad = files.withColumn("content", F.concat("content", F.unhex(F.lit("FF")).cast("string")))
    assert secrets.secrets_strict(bad).count() == 0
    assert secrets.secrets_gate(bad).count() == 1


def test_user_rules_from_a_table(spark, make_files):
    table = spark.createDataFrame([(0, "secret", "MINE", r"mine-[0-9]{3}", "HIGH")],
                                  "ordinal int, family string, type string, regex string, severity string")
    rules = rules_from_table(table)
    assert rules == (Rule(0, "secret", "MINE", r"mine-[0-9]{3}", "HIGH"),)
    got = secrets.secrets_gate(make_files(("a.py", "x mine-123 y")), rules).first()
    assert (got.type, got.severity, got.match) == ("MINE", "HIGH", "***")
    with pytest.raises(ValueError):
        rules_from_table(table.unionAll(table), limit=1)


def test_one_secret_copied_into_most_files(make_files):
    key, other = 'k = "AKIA' + "A1B2C3D4E5F6G7H8" + '"', 'k = "AKIA' + "Z1B2C3D4E5F6G7H8" + '"'
    files = make_files(*((f"d{i % 7}/f{i}.py", f"x\n{key}\n{key}") for i in range(300)),
                       ("z.py", other)).repartition(8)
    gate = sorted((r.file, r.line) for r in secrets.secrets_gate(files).collect())
    assert gate == [("d0/f0.py", 2), ("z.py", 1)]
    assert secrets.secrets_strict(files).count() == 301
