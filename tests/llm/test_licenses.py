"""License scans against a plain search over the same windows."""

import math
import random
import re

from foretally.llm import licenses

SCHEMA = "doc_id long, text string, license string, rid int"
OWN = {"five": "alpha beta gamma delta epsilon", "twelve": " ".join(f"w{i}" for i in range(12)), "long": " ".join(f"v{i % 37}x{i}" for i in range(70)),
       "pair": "too short"}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(w):
    return [tuple(w[i:i + 3]) for i in range(len(w) - 2)]


def plain(rows, templates):
    out = []
    for doc, text, *_ in rows:
        s = grams(words(text))
        for name, notice in templates.items():
            t = set(grams(words(notice)))
            if not t:
                continue
            span = 2 ** math.ceil(math.log2(len(t)))
            best = max(((len(t & set(s[k:k + 2 * span])), -k) for k in range(0, len(s), span)), default=(0, 0))
            if best[0] >= 0.8 * len(t):
                out.append((doc, name, best[0], len(t), -best[1]))
    return sorted(out, key=str)


def rows(templates):
    rng = random.Random(3)
    filler = [f"f{i}" for i in range(500)] + ["the", "license", "alpha", "w1", "Été"]
    notices = list(templates.values())
    out = []
    for i in range(120):
        parts = rng.choices(filler, k=rng.randint(0, 120))
        for _ in range(rng.choice([0, 1, 1, 2])):
            cut = rng.choice(notices).split(" ")
            if rng.random() < 0.3 and len(cut) > 3:
                cut[rng.randrange(len(cut))] = "changed"
            at = rng.randint(0, len(parts))
            parts[at:at] = cut
        out.append((i, rng.choice([" ", ",\n", " - "]).join(parts).upper() if i % 5 == 0 else " ".join(parts), "x", i))
    long = " ".join(rng.choices(filler, k=30000))
    return out + [(200, None, None, None), (201, "", "x", 1), (None, notices[0], "x", 1), (202, notices[1], "x", 1), (202, notices[1], "x", 1),
                  (203, long + " " + notices[0] + " " + long, "x", 1), (204, "two words", "x", 1)]


def found(spark, data, templates):
    got = licenses.scan(spark.createDataFrame(data, SCHEMA).repartition(3), templates, carry=["doc_id"])
    return sorted(map(tuple, got.select("row.doc_id", "license", "n_found", "n_shingles", "window_start").collect()), key=str)


def test_against_plain_search(spark):
    for templates in (OWN, licenses.TEMPLATES):
        data = rows(templates)
        assert found(spark, data, templates) == plain(data, templates)


def test_empty_table_and_clashing_names(spark):
    assert found(spark, [], OWN) == []
    got = licenses.scan(spark.createDataFrame([(1, "x " + OWN["five"], "mine", 7)], SCHEMA), OWN)
    assert [tuple(r) for r in got.select("row.*").collect()] == [(1, "x " + OWN["five"], "mine", 7)]


def test_relatives_and_older_versions_are_told_apart(spark):
    notices = licenses.TEMPLATES
    around = " ".join(f"f{i}" for i in range(40))
    named = lambda text: [(i, f"{around} {t} {around}", "x", i) for i, t in enumerate(text)]
    got = licenses.scan(spark.createDataFrame(named(notices.values()), SCHEMA), carry=["doc_id"], phrases=licenses.PHRASES)
    assert sorted((r["row"]["doc_id"], r["license"]) for r in got.collect()) == list(enumerate(notices))
    others = [notices["GPL-3.0"].replace("version 3", "version 2"), notices["GPL-3.0"].replace("General", "Lesser General"), notices["MPL-2.0"].replace("2.0", "1.1"),
              notices["LGPL header"].replace("Lesser", "Library"), notices["GPL header"].replace("General", "Affero General"),
              notices["Apache-2.0"].replace("2.0", "1.1"), notices["CC-BY-NC-4.0"].replace("NC", "NC-SA"), notices["CC-BY-4.0"].replace("4.0", "3.0"),
              notices["LGPL header"].replace("Lesser", "Library") + " the GNU General Public License, version 3"]
    got = licenses.scan(spark.createDataFrame(named(others), SCHEMA), carry=["doc_id"], phrases=licenses.PHRASES)
    assert got.collect() == []


def test_a_changed_notice_beside_its_relative_is_found(spark):
    """The relative holds more of the template's shingles than the changed notice does."""
    gpl, lgpl = licenses.TEMPLATES["GPL header"], licenses.TEMPLATES["LGPL header"]
    text = lgpl + " " + " ".join(f"f{i}" for i in range(200)) + " " + gpl.replace("redistribute", "spread")
    got = licenses.scan(spark.createDataFrame([(1, text, "x", 1)], SCHEMA), carry=["doc_id"], phrases=licenses.PHRASES)
    assert sorted(r["license"] for r in got.collect()) == ["GPL header", "LGPL header"]
