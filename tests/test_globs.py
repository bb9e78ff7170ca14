"""Ignore rules against fnmatch and a directory walk written for the test."""

import fnmatch
import random
import re

from pyspark.sql import functions as F

from gistmill import fixed_values as fv
from gistmill.functions.globs import compile_rules, glob_regex
from gistmill.operators import ignore


def hit(path, rules):
    name = path.rsplit("/", 1)[-1]
    if name == fv.DIGEST_FILE:
        return True
    for rule in rules:
        if rule.endswith("/*"):
            if fnmatch.fnmatchcase(path, rule[:-2]) or path.startswith(rule[:-2] + "/"):
                return True
        elif fnmatch.fnmatchcase(path, rule) or fnmatch.fnmatchcase(name, rule):
            return True
    return False


def walk_class(path, rules):
    parts = path.split("/")
    if any(hit("/".join(parts[:n]), rules) for n in range(1, len(parts))):
        return "pruned"
    return "ignored" if hit(path, rules) else "kept"


def test_glob_regex_agrees_with_fnmatch():
    rng = random.Random(7)
    for _ in range(30000):
        pattern = "".join(rng.choice("ab/*?[]!-.^c&|~\\") for _ in range(rng.randint(1, 7)))
        text = "".join(rng.choice("ab/.c-!]^[&\\\n") for _ in range(rng.randint(0, 6)))
        ours = re.fullmatch(glob_regex(pattern), text, re.DOTALL) is not None
        assert ours == fnmatch.fnmatchcase(text, pattern), (pattern, text)


def random_paths(rng, rules, count):
    names = ["src", "a", "lib", "build", "x.log", "y.egg-info", "doc.md", ".env", "Thumbs.db", "node_modules",
             "q q.py", "docs", "_build", "t.tmp", "Icon\r", "npm-debug.log.1", ".env.dev.local", fv.DIGEST_FILE,
             ".coverage.x", "vendor", "bundle", "a*b", "target"]
    names += [rule.rstrip("*").rstrip("/").replace("*", "k").strip("/") or "z" for rule in rules]
    return ["/".join(rng.choice(names) for _ in range(rng.randint(1, 4))) for _ in range(count)]


def test_default_rules_agree_with_a_walk(spark):
    rng = random.Random(11)
    paths = random_paths(rng, fv.DEFAULT_IGNORE_RULES, 6000)
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select(
        "path", ignore.scan_class(F.col("path")).alias("c")
    ).collect()
    assert {r.c for r in rows} == {"kept", "ignored", "pruned"}
    for row in rows:
        assert row.c == walk_class(row.path, fv.DEFAULT_IGNORE_RULES), row.path


def test_odd_rules_agree_with_a_walk(spark):
    rng = random.Random(13)
    for _ in range(12):
        rules = ["".join(rng.choice("ab/*?[]!-.") for _ in range(rng.randint(1, 5))) + rng.choice(["", "/*"])
                 for _ in range(4)]
        paths = ["/".join("".join(rng.choice("ab.-[") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 4)))
                 for _ in range(400)]
        rows = spark.createDataFrame([(p,) for p in paths], "path string").select(
            "path", ignore.scan_class(F.col("path"), rules).alias("c")
        ).collect()
        for row in rows:
            assert row.c == walk_class(row.path, rules), (rules, row.path)
        compiled = compile_rules(tuple(rules), fv.DIGEST_FILE)
        assert all(compiled.hits(p) == hit(p, rules) for p in paths)


def test_slashes_in_character_classes(spark):
    rng = random.Random(19)
    fixed = [["[a/b]x"], ["[!/]x"], ["[a/b]x", "[!/]x/*"]]
    drawn = [[rng.choice(["[a/b]", "[!/]", "[+-0]", "a"]) + rng.choice(["x", "*", "?x", "[/]"]) for _ in range(3)] for _ in range(6)]
    for rules in fixed + drawn:
        paths = ["dir/ax", "ax", "bx/c", "d/bx/c", *["/".join(rng.choice(["ax", "x", "ab", "bx", "axx"]) for _ in range(rng.randint(1, 4))) for _ in range(80)]]
        rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", ignore.scan_class(F.col("path"), rules).alias("c")).collect()
        for row in rows:
            assert row.c == walk_class(row.path, rules), (rules, row.path)
    assert scan_of(spark, "dir/ax", ["[a/b]x"]) == scan_of(spark, "dir/ax", ["[!/]x"]) == "ignored"


def scan_of(spark, path, rules):
    return spark.createDataFrame([(path,)], "path string").select(ignore.scan_class(F.col("path"), rules)).first()[0]


def test_depth_and_trailing_slash(spark):
    cases = {
        "node_modules/a": "pruned", "src/node_modules/a": "kept", "x/y.egg-info/z": "pruned",
        ".env/a.py": "pruned", ".env": "ignored", "build": "ignored", "out/a": "kept", "gen/a": "kept",
    }
    rows = spark.createDataFrame([(p,) for p in cases], "path string").select(
        "path", ignore.scan_class(F.col("path"), fv.DEFAULT_IGNORE_RULES + ("gen/",)).alias("c")
    ).collect()
    assert {r.path: r.c for r in rows} == cases


def test_rules_per_corpus(spark):
    rng = random.Random(17)
    own = {"a": ["*.md", "gen/*", "q?"], "b": ["[ab]*.py"], "c": []}
    lines = spark.createDataFrame(
        [(c, f"  {rule}\t") for c, rules in own.items() for rule in rules] + [("a", "# note"), ("b", "  ")],
        "corpus_id string, line string",
    )
    paths = random_paths(rng, ("gen/*", "q1", "ab.py", "note.md"), 300)
    files = spark.createDataFrame([(c, p) for c in own for p in set(paths)], "corpus_id string, relative_path string")
    usable = ignore.usable_rules(lines)
    assert ignore.with_corpus_rules(files, usable).count() == files.count()
    for row in ignore.with_scan_class(files, usable).collect():
        rules = list(fv.DEFAULT_IGNORE_RULES) + own[row.corpus_id]
        assert row.scan_class == walk_class(row.relative_path, rules)
    table = ignore.rule_table(lines, files.select("corpus_id").distinct())
    counts = {r.corpus_id: r["count"] for r in table.groupBy("corpus_id").count().collect()}
    assert counts == {"a": 110, "b": 108, "c": 107}


ODD_RULES = [
    "*", "**", "?", "a?", "[ab]*.py", "[!a]b", "[!]", "[]", "[]]x", "[!]]x", "[z-a]", "[!z-a]x", "[a-c-e]", "[/]x", "a[/]b", "[!/]b", "src/[a-c]/*",
    "s*c/*", "src/*", "*/gen/*", "/*", "*/", "gen/", "a/b", "*a/b", "*/b", "*.py", "**.md", "*.t?t", "x[", "x[!", "[", "a.b", "a+b", "(a|b)", "^a$",
    "a\\b", "é*", "[é-ü]x", "*é", "日?", "[日]", "-", "[a-]", "[-a]", "[\\\\]", "[^a]b", "q{2}", "#x", "a b", "*.p[yx]", "src*", "?rc/a", "*[0-9]",
]


def test_rules_in_a_column(spark):
    """Shapes and regexes made by column functions, against the walk, for each rule alone and for all together."""
    rng = random.Random(5)
    letters = ["a", "b", "x", "src", "gen", "é", "ü", "日", "]", "[", "!", "-", ".py", ".md", ".txt", "c", "\\", "^", "a b", "1", "(a|b)", "q{2}", "a+b"]
    names = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 3))) for _ in range(120)] + ["a", "b", "ab", "src", "gen", "]x", "ax", "x[", "日本"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randint(1, 3))) for _ in range(350)} | {"src/a/f", "x/gen/f", "a/b", "a/b/c", "src/gen"})
    own = {f"c{i}": [rule] for i, rule in enumerate(ODD_RULES)} | {"all but stars": [r for r in ODD_RULES if set(r) - set("*?")][10:30]}
    for i in range(80):
        own[f"random {i}"] = ["".join(rng.choice("ab/*?[]!-.^c&|~\\") for _ in range(rng.randint(1, 7)))]
    rules = spark.createDataFrame([(c, r) for c, rs in own.items() for r in rs], "corpus_id string, pattern string")
    files = spark.createDataFrame([(c, p) for c in own for p in paths], "corpus_id string, relative_path string")
    wrong = []
    for row in ignore.with_scan_class(files, rules, rules=(), own_output="no such name").collect():
        if row.scan_class != walk_class(row.relative_path, own[row.corpus_id]):
            wrong.append((own[row.corpus_id], row.relative_path, row.scan_class))
    assert wrong == []


def test_rules_per_corpus_need_no_python(spark):
    from gistmill.plans import queries as catalogue

    plan = catalogue.QUERIES["scan_class_by_corpus"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "MapIn" not in plan and "pythonUDF" not in plan
