"""Scan inputs derived from the driver's ``documents`` and ``events`` tables.

The raw tables contain almost nothing the rules look for, so every document becomes a
small source file with one known line appended, chosen by ``doc_id`` alone. All values
are synthetic. The expressions are written in SQL both Spark and DuckDB accept, so a
checker can rebuild the same inputs on its own.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.session import use_local_scratch
from wardlake.sources.files import spread

# {H} is the md5 of doc_id, {Hn} its first n characters, {U16} the first 16 in capitals,
# {G16} the same from the repository's md5.
PLANTS: tuple[tuple[str, str], ...] = (
    (".py", 'access = "AKIA{U16}"'),
    (".env", 'aws_secret_access_key = "{H}{H8}"'),
    (".go", 'tok := "ghp_{H}{H8}"'),
    (".yml", 'token: "glpat-{H20}"'),
    (".pem", "-----BEGIN RSA PRIVATE KEY-----"),
    (".js", 'api_key = "{H}"'),
    (".env", 'password = "{H12}"'),
    (".py", 'db = "postgres://u:{H8}@db/x"'),
    (".js", 't = "eyJ{H}.eyJ{H}.{H}"'),
    (".http", "Authorization: Bearer {H}.{H}.{H}"),
    (".rb", 'k = "sk_live_{H}"'),
    (".ts", 'sid = "SK{H}"'),
    (".py", 'sg = "SG.{H22}.{H}{H11}"'),
    (".py", 'mg = "key-{H}"'),
    (".js", 'slack = "xoxb-{H}"'),
    (".js", 'bot = "M{H}.{H6}.{H}"'),
    (".java", 'g = "AIza{H}abc"'),
    (".cs", 'azure_key = "{H}{H12}"'),
    (".js", 'x = eval(q + "a")'),
    (".py", "subprocess.call(cmd)"),
    (".py", "os.system(cmd)"),
    (".py", 'cur.execute("select %s" % v)'),
    (".py", "o = pickle.loads(b)"),
    (".go", 'host := "10.1.2.3"'),
    (".js", "el.innerHTML = a + b;"),
    (".js", 'f("../up")'),
    (".php", 'system("ls $dir")'),
    (".py", "h = hashlib.md5(b)"),
    (".js", "eval(req.body)"),
    (".js", "c.query(`x {a} y`)"),
    (".rs", "let p = unsafe { *q };"),
    (".rs", "let v = m.get(1).unwrap();"),
    (".py", "exec(src)"),
    (".go", 'rows, _ := db.Query("a" + b, " + c")'),
    (".py", "# AKIA{U16}"),
    ("_test.go", 'api_key = "{H}"'),
    (".md", "ghp_{H}{H8}"),
    (".rb", 'k = "sk_test_{H}"'),
    (".js", "// eval(x)"),
    (".go", 'bind := "127.0.0.1"'),
    (".py", "password: hunter2hunter2"),
    (".py", 's = "eval(1)"  # eval(2)'),
    (".py", 'access = "AKIA{U16}"{NL}access = "AKIA{U16}"'),
    (".py", 'access = "AKIA{G16}"'),
    (".py", 'access = "AKIA{G16}"'),
)
PLANT_CYCLE = 50
REPO = "concat('repo', cast(cast(floor(doc_id / 4) as bigint) as string))"
KEY_COLUMNS = {
    "repo_path": REPO,
    "branch": "case cast(floor(doc_id / 4) as bigint) % 5 when 0 then 'main' when 1 then 'master' "
              "when 2 then 'staging' when 3 then 'feature/x' else 'develop' end",
    "commit_hash": f"md5({REPO})",
}
DIGEST = "md5(cast(doc_id as string))"
FILLERS = {
    "{H}": DIGEST,
    **{f"{{H{n}}}": f"substr({DIGEST}, 1, {n})" for n in (6, 8, 11, 12, 20, 22)},
    "{U16}": f"upper(substr({DIGEST}, 1, 16))",
    "{G16}": f"upper(substr(md5({REPO}), 1, 16))",
    "{NL}": "chr(10)",
}


def pick(values: list[str], index: str, dialect: str) -> str:
    """SQL for ``values[index]``; a constant array in either dialect."""
    items = ", ".join(f"'{v}'" for v in values)
    if dialect == "spark":
        return f"element_at(array({items}), cast({index} as int) + 1)"
    return f"list_extract([{items}], cast({index} as int) + 1)"


def planted() -> str:
    """DuckDB SQL for the planted text: a template by ``doc_id``, its fillers replaced."""
    blank = [""] * (PLANT_CYCLE - len(PLANTS))
    sql = pick([text for _, text in PLANTS] + blank, f"doc_id % {PLANT_CYCLE}", "duckdb")
    for name, value in FILLERS.items():
        sql = f"replace({sql}, '{name}', {value})"
    return sql


def extension(dialect: str) -> str:
    rest = [".py"] * (PLANT_CYCLE - len(PLANTS))
    return pick([ext for ext, _ in PLANTS] + rest, f"doc_id % {PLANT_CYCLE}", dialect)


def file_columns() -> dict[str, str]:
    """DuckDB SQL of the columns of :func:`code_files`."""
    return {
        **KEY_COLUMNS,
        "path": f"concat({REPO}, '/', lang, '/f', cast(doc_id as string), {extension('duckdb')})",
        "content": f"concat(text, chr(10), {planted()})",
    }


# Directory and extension mix for the path filters.
TREE_DIRS = ("src", "build", "dist-info", "node_modules", ".github", "vendor", "target",
             ".cargo", "__pycache__", "lib", "distance", "rebuild", ".git")
TREE_EXTS = (".py", ".jpg", ".jpeg", ".so", ".tar", ".rs", ".java", ".h", ".md", ".go", "")
TREE_PATH = (
    f"concat({REPO}, '/', case doc_id % 13 "
    + " ".join(f"when {i} then '{d}'" for i, d in enumerate(TREE_DIRS))
    + " end, '/f', cast(doc_id as string), case doc_id % 11 "
    + " ".join(f"when {i} then '{e}'" for i, e in enumerate(TREE_EXTS)) + " end)")

MANIFEST_COLUMNS = {
    **KEY_COLUMNS,
    "path": f"concat({REPO}, '/', case cast(floor(doc_id / 4) as bigint) % 6 "
            "when 0 then 'requirements.txt' when 4 then 'go.mod' when 5 then 'sub/package.json' "
            "else 'package.json' end)",
    "content": "case cast(floor(doc_id / 4) as bigint) % 6 when 0 then 'django==2.2' "
               "when 2 then '{\"lodash\": \"4.16.1\"}' "
               "when 3 then '{\"express\": \"3.1\", \"lodash\": \"4.16.1\"}' "
               "when 4 then 'module x' else '{\"express\": \"3.1\"}' end",
}


def _columns(spec: dict[str, str]) -> list[str]:
    return [f"{sql} as {name}" for name, sql in spec.items()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, the start of every registered query."""
    use_local_scratch(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _expressions(spec: dict[str, str]) -> list[Column]:
    return [F.expr(sql).alias(name) for name, sql in spec.items()]


def _source_file() -> tuple[Column, Column]:
    """Path and content. Built call by call: nested SQL text of this depth parses slowly."""
    k = f"doc_id % {PLANT_CYCLE}"
    templates = [text for _, text in PLANTS] + [""] * (PLANT_CYCLE - len(PLANTS))
    planted_line = F.expr(pick(templates, k, "spark"))
    for name, value in FILLERS.items():
        planted_line = F.replace(planted_line, F.lit(name), F.expr(value))
    path = F.concat(F.expr(REPO), F.lit("/"), "lang", F.lit("/f"),
                    F.col("doc_id").cast("string"), F.expr(extension("spark")))
    return path, F.concat("text", F.lit("\n"), planted_line)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, content = _source_file()
    return documents(spark, sf_dir).select(
        *_expressions(KEY_COLUMNS), path.alias("path"), content.alias("content"))


def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        *_columns({**KEY_COLUMNS, "path": TREE_PATH, "content": "text"}))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest per repository, whichever of its documents are there."""
    return table(spark, sf_dir, "documents").selectExpr(*_columns(MANIFEST_COLUMNS)).distinct()


def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files and manifests of every repository; the text is read once."""
    return code_files(spark, sf_dir).unionByName(manifests(spark, sf_dir))


REQUEST_COLUMNS = {
    **KEY_COLUMNS,
    "scan_ts": "timestamp '2024-03-01 00:00:00'",
    "deploy_env": "cast(null as string)",
    "r": "cast(floor(doc_id / 4) as bigint)",
}
POLICY_COLUMNS = {
    "environment": "case r % 3 when 0 then 'production' when 1 then 'staging' "
                   "else 'development' end",
    "approved_by": "case when r % 3 = 0 then 'a' end",
    "emergency_approved": "r % 4 = 0",
    "cve_status": "case when r % 2 = 0 then 'passed' else 'failed' end",
    "dependencies_scanned": "r % 7 <> 0",
}


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan request per repository."""
    base = table(spark, sf_dir, "documents").selectExpr(*_columns(REQUEST_COLUMNS)).distinct()
    passed = F.lit("passed")
    status = {"secrets": passed, "cve": F.col("cve_status"), "code_analysis": passed}
    scanners = F.map_from_arrays(
        F.array(*(F.lit(k) for k in status)),
        F.array(*(F.struct(v.alias("status")) for v in status.values())))
    return (base.selectExpr("*", *_columns(POLICY_COLUMNS))
            .withColumn("scanners", scanners).drop("r", "cve_status"))


EVENT_COLUMNS = {
    "host": "concat('h', cast(user_id % 10 as string))",
    "event_id": "event_id",
    "k": "cast(get_json_object(props, '$.k') as int)",
    "event_type": "event_type",
    "user_id": "user_id",
    "value": "value",
}
# The low k values stand for well-known backdoor ports.
PORT = ("case k when 0 then 4444 when 1 then 5555 when 2 then 6667 when 3 then 31337 "
        "when 4 then 12345 when 5 then 1337 when 6 then 6666 when 7 then 7777 else 8000 + k end")
NET_LINE = (f"concat('tcp 0 0 0.0.0.0:', cast({PORT} as string), ' 0.0.0.0:* LISTEN', "
            "case when event_id % 400 = 0 then ' /bin/bash' else '' end)")
PROCESS_LINE = ("concat('root 1 0.0 ', event_type, "
                "case when event_id % 500 = 0 then ' xmrig' else '' end)")
WATCHED_PATH = ("case k % 5 when 0 then '/etc/passwd' when 1 then '/etc/shadow' "
                "when 2 then '/etc/sudoers' when 3 then '/root/.ssh/authorized_keys' "
                "else concat('/home/u', cast(user_id as string), '/.ssh/authorized_keys') end")


def event_ticks(events: DataFrame) -> DataFrame:
    """Events by host and 4-hour tick; ``seq`` is the event id, which orders lines in a tick."""
    # Floored on the wall-clock fields, so the session's time zone does not matter.
    tick = F.expr("cast(date_trunc('HOUR', ts) - make_dt_interval(0, hour(ts) % 4) as timestamp)")
    return events.selectExpr(*_columns(EVENT_COLUMNS), "ts").select(
        "host", tick.alias("tick_ts"), F.col("event_id").cast("int").alias("seq"), "event_id", "k",
        "event_type", "user_id", "value")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_ticks(spread(table(spark, sf_dir, "events"), "event_id"))


def net_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr("host", "tick_ts", "seq", f"{NET_LINE} as line")


def process_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr("host", "tick_ts", "seq",
                                             f"{PROCESS_LINE} as line")


def file_mtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(
        "host", "tick_ts", f"{WATCHED_PATH} as path",
        "timestamp_micros(unix_micros(tick_ts) - cast(round(value * 30000000) as bigint)) as mtime",
        "event_id")
