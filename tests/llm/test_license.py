"""License labels against a plain Python version: runs on diagonals, and the best chain of runs by dynamic programming."""

import random

from caseloom.llm import license_scan
from caseloom.llm.license_texts import PASSAGES
from tests.llm import brute


def runs_of(hits):
    """Hits (pos, tpos) as runs on a diagonal: (s, t, length)."""
    out = []
    for p, q in sorted(hits, key=lambda h: (h[0] - h[1], h[0])):
        if out and out[-1][0] - out[-1][1] == p - q and out[-1][0] + out[-1][2] == p:
            out[-1] = (*out[-1][:2], out[-1][2] + 1)
        else:
            out.append((p, q, 1))
    return sorted(x for x in out if x[2] >= 2)


def labels_of(text, share=0.85, gap=21):
    w = brute.PLAIN.findall((text or "").translate(brute.UP))
    found = {}
    for label, passage in PASSAGES:
        t = passage.split()
        at = {}
        for i in range(len(t) - 1):
            at.setdefault(tuple(t[i : i + 2]), []).append(i)
        runs, best = runs_of([(pos, tpos) for pos in range(len(w) - 1) for tpos in at.get(tuple(w[pos : pos + 2]), [])]), {}
        for x in runs:
            before = [n for y, n in best.items() if 0 <= x[0] - y[0] - y[2] <= gap and 0 <= x[1] - y[1] - y[2] <= gap]
            best[x] = x[2] + max(before, default=0)
        n = max(best.values(), default=0) / (len(t) - 1)
        if n >= share - 1e-9:
            found[label] = n
    return found


def texts():
    r = random.Random(5)
    out = [
        "licensed under cc by 4 0 x 4 0 x 4 0 x 4 0 x 4 0 x 4 0 x 4 0 x 4 0",
        "licensed under the apache license version 2 0 " * 30,
        "0 4 by cc under licensed",
        "this work is licensed under CC BY-NC 4.0. licensed under x x x x x x x cc by 4 0",
        None,
        "",
        "of the",
    ]
    for _, passage in PASSAGES:
        w = passage.split()
        for loss in (0.0, 0.03, 0.1):
            changed = [x for x in w if r.random() >= loss]
            for _ in range(int(loss * len(w) / 2)):
                changed.insert(r.randrange(len(changed) + 1), "foo")
            out.append(" ".join(["of", "the", "software"] * 5 + changed + ["in", "the", "use"] * 4))
        halves = w[len(w) // 2 :] + ["bar"] * 40 + w[: len(w) // 2]
        out.append(" ".join(halves))
    return out


def test_labels_match_plain_python(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows + [rows[0]], "doc_id long, text string").repartition(3)
    got = license_scan.license_scan(df).collect()
    assert len(got) == len(rows) + 1
    several = 0
    for r in got:
        want = labels_of(dict(rows)[r["doc_id"]])
        base = set(r["base_labels"])
        assert set(r["labels"]) - base == set(want), r["doc_id"]
        assert abs(r["score"] - max([*want.values(), *[1.0] * bool(base)], default=0)) < 1e-12
        for s in r["spans"] or []:
            assert s["end"] <= r["n_words"] and 0 <= s["start"] < s["end"]
        several += len(want)
    assert several > 30
    first = next(r for r in got if r["doc_id"] == 0)
    assert "cc-by-4.0" in first["labels"]
    again = next(r for r in got if r["doc_id"] == 1)
    assert sum(s["label"] == "apache-2.0" for s in again["spans"]) == 30


def test_words_put_into_a_license_do_not_hide_it(spark):
    """A holder's name of up to twenty words in the middle, a lost line, and words replaced all over."""
    w = dict(PASSAGES)["mit-text"].split()
    half = len(w) // 2
    made = [w[:half] + ["name"] * k + w[half:] for k in (1, 4, 8, 15, 20)] + [w[:half] + w[half + 9 :], [x if i % 31 else "zz" for i, x in enumerate(w)]]
    rows = [(i, " ".join(["intro"] * 9 + x + ["end"])) for i, x in enumerate(made)] + [(50, " ".join(w[:half] + ["name"] * 300 + w[half:])), (51, " ".join(w[half:] + w[:half]))]
    got = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, x in enumerate(made):
        assert got[i]["labels"] == ["mit-text"] and got[i]["spans"][0]["start"] == 9 + (i == 6) and got[i]["spans"][0]["end"] == 9 + len(x), i
    assert got[50]["labels"] == [] and got[51]["labels"] == []
