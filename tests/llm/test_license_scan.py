"""License scans against every window of every text."""

import random
import re

import pytest

from palimpsest.llm import license_scan


def words(text):
    return [w for w in re.split(license_scan_split, " " + (text or "").lower() + " ") if w]


punct = re.escape("!\"#$%&'()*+,./:;<=>?@[\\]^_`{|}~")
license_scan_split = rf"[\s{punct}]*\s+[\s{punct}]*"


def brute(rows, contained=0.8, k=5):
    sh = lambda w: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    out = {}
    for d, t in rows:
        s = sh(words(t))
        for name, template in license_scan.TEMPLATES.items():
            tw = words(template)
            ts = set(sh(tw))
            z = 2 << (len(tw) - 1).bit_length()
            for a in range(0, max(1, len(s)), z // 2):
                c = len(set(s[a : a + z - k + 1]) & ts) / len(ts)
                if c >= contained:
                    out[d, name] = max(out.get((d, name), (0, 0)), (round(c, 6), -a))
    return sorted(((d, n, c, -a) for (d, n), (c, a) in out.items()), key=repr)


@pytest.mark.parametrize("seed", [1])
def test_against_every_window(spark, seed):
    r = random.Random(seed)
    vocab = ["under", "the", "license", "software", "foo", "bär", "free", "licensed", "of", "version"]
    fill = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    rows = []
    for d in range(60):
        parts = [fill(r.randint(0, 90))]
        for _ in range(r.choice([0, 0, 1, 2])):
            w = r.choice(list(license_scan.TEMPLATES.values())).split()
            for _ in range(r.choice([0, 0, 1, len(w) // 30])):
                w[r.randrange(len(w))] = "other"
            parts += [r.choice(["\n", " "]) + " ".join(w) + r.choice([".", "\n"]), fill(r.randint(0, 200))]
        rows.append((d, " ".join(parts)))
    rows += [(60, None), (61, ""), (62, "Released under"), (63, "released UNDER\n\tthe (MIT) license"), (63, "released UNDER\n\tthe (MIT) license"), (None, license_scan.TEMPLATES["GPL-3.0"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS size", "2 AS license", "3 AS start")
    got = sorted((tuple(x) for x in license_scan.scan(df).collect()), key=repr)
    assert got == brute(rows) and len(got) > 30
    assert license_scan.scan(df.limit(0)).collect() == []


def test_short_templates_are_refused(spark):
    with pytest.raises(ValueError, match="fewer"):
        license_scan.scan(spark.createDataFrame([], "doc_id long, text string"), {"x": "too short"})


def test_templates_as_a_table_of_whole_texts(spark):
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)]
    whole = {f"L{k}": " ".join(r.choice(vocab) for _ in range(400 + 100 * k)) for k in range(12)}
    fill = lambda: " ".join(r.choice(vocab) for _ in range(200))
    rows = [(k, f"{fill()} {t} {fill()}") for k, t in enumerate(whole.values())] + [(100, fill()), (101, " ".join(whole["L3"].split()[:100]))]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(whole.items()), "license string, template string")).collect()
    assert sorted((x.doc_id, x.license, x.containment) for x in got) == [(k, f"L{k}", 1.0) for k in range(12)]
