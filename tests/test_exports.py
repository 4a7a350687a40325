"""JSON exports against a plain walk, and the steps of it that are done once."""

import json
import random
import re

from pyspark.sql import functions as F

from threadloom.functions import scalars
from threadloom.sources import exports

BLANKS = " \t\n\x0b\f\r        　﻿"
CLASS = "[ \t\n\x0b\f\r   -     　﻿]+"


def plain_clean(t):
    t = re.sub(CLASS, " ", t.replace("\0", ""))
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        t = re.sub(f"(?i)&{name};", char, t)
    return re.sub(f"^{CLASS}|{CLASS}$", "", t)


def test_clean_text_equals_plain_rules(spark):
    rng = random.Random(5)
    texts = ["", *BLANKS, "é—ü", "\0 a \0"] + ["".join(rng.choice([*BLANKS, "a", "é", "字", "​", "—", "\0", "&nbsp;", "&NBSP;", "&amp;", "&lt;", "nbsp;", " ", " "]) for _ in range(rng.randrange(12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = df.select("t", scalars.clean_text(F.col("t")).alias("c"), scalars.trim_all(F.col("t")).alias("s")).collect()
    assert [(r["c"], r["s"]) for r in got] == [(plain_clean(t), re.sub(f"^{CLASS}|{CLASS}\\Z", "", t)) for t in texts] + [(None, None)]


def walk(v, depth, found):
    if isinstance(v, dict):
        first = lambda names: next((v[n] for n in names if isinstance(v.get(n), (str, int)) and not isinstance(v.get(n), bool)), None)
        content, sender, time = (first(exports.JSON_FIELDS[k]) for k in ("content", "sender", "time"))
        if content not in (None, "") and sender not in (None, "") and len(plain_clean(str(content))) >= 2 and plain_clean(str(sender)):
            found.append((plain_clean(str(sender)), None if time is None or time == "" else str(time).strip(" "), plain_clean(str(content))))
    if depth and isinstance(v, (dict, list)):
        for x in [v[k] for k in sorted(v)] if isinstance(v, dict) else v:
            walk(x, depth - 1, found)


def test_json_exports_equal_a_plain_walk(spark):
    rng = random.Random(6)

    def value(depth):
        kind = rng.randrange(7 if depth else 4)
        if kind < 4:
            return rng.choice(["", "x", "some text", 7, 1234, True, None, [], {}, " two  words "])
        if kind == 4:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return {k: value(depth - 1) for k in rng.sample(["content", "text", "sender", "from", "time", "date", "message", "list", "zz"], rng.randrange(1, 7))}

    files = [value(5) for _ in range(600)]
    df = spark.createDataFrame([(str(i), json.dumps(v)) for i, v in enumerate(files)] + [("broken", '{"sender": "a", "content": "lost"'), ("none", None)], "path string, text string")
    for depth in (0, 2, 8):
        want = []
        for i, v in enumerate(files):
            found = []
            walk(v, depth, found)
            want += [(str(i), n, *m) for n, m in enumerate(found)]
        got = [(r["path"], r["n"], r["sender"], r["time"], r["content"]) for r in exports.read_json_exports(df, depth).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr) and want


def test_files_are_parsed_and_texts_cleaned_once(spark):
    df = spark.createDataFrame([("p", "[]")], "path string, text string")
    plan = exports.read_json_exports(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.count("(?i)&nbsp;") == 2
