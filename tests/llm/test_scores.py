"""Language, quality and licence operators: held-out accuracy and odd input."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from gristmill.llm import language, license_scan, quality
from tests.llm.fixtures import frame, odd_texts, prose

TONGUES = {
    "aa": "tha ing ous the and ly shed ou er".split(),
    "bb": "ción rra ez os ña del ll mente".split(),
    "cc": "ung sch heit ß ö ich ver ein".split(),
}


def speech(lang, seed, n=60):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(TONGUES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_languages_are_found_on_held_out_rows(spark):
    langs = [list(TONGUES)[k % 3] for k in range(240)]
    docs = frame(spark, [speech(x, k, 20 + k) for k, x in enumerate(langs)], langs=langs)
    out = language.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k in range(240) if zlib.crc32(str(k).encode()) % 4 == 2}
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)


def test_labels_of_held_out_rows_are_not_used(spark):
    langs = [list(TONGUES)[k % 3] if zlib.crc32(str(k).encode()) % 4 != 2 else "zz" for k in range(60)]
    docs = frame(spark, [speech(list(TONGUES)[k % 3], k) for k in range(60)], langs=langs)
    assert "zz" not in language.learn(docs).langs


def test_languages_of_odd_rows(spark):
    texts = [*odd_texts(), speech("bb", 3)]
    docs = frame(spark, texts, langs=["aa", None] * 9 + ["bb"])
    got = {r["doc_id"]: r for r in language.language_report(docs).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        no_letter = not any(c.isalpha() for c in t or "")
        assert (got[k]["lang_pred"] == "und") == no_letter
    none = language.language_report(frame(spark, ["some text"], langs=[None])).collect()
    assert none[0]["lang_pred"] == "und" and none[0]["score"] == 0
    assert language.language_report(docs.limit(0)).count() == 0


def test_language_report_equals_a_plain_version(spark):
    langs = [list(TONGUES)[k % 3] for k in range(60)]
    texts = [speech(x, k, 15 + k % 40) for k, x in enumerate(langs)] + ["", None, "!?", "ß", speech("aa", 1) + speech("bb", 2)]
    langs += ["aa", "bb", None, "cc", None]
    ranks, counts = language.RANKS, {}

    def grams(text):
        out = {}
        for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
            s = f" {w} "
            for n in (1, 2, 3):
                for k in range(len(s) - n + 1):
                    g = s[k : k + n]
                    if g.strip() and (n < 3 or g[1] != " "):
                        out[g] = out.get(g, 0) + 1
        return out

    def number(g):  # the order of ties: the packed code points, blanks 0
        p = [0 if c == " " else ord(c) for c in g]
        return p[0] if len(p) == 1 else (p[0] << 21 | p[1]) | 1 << 42 if len(p) == 2 else p[0] << 42 | p[1] << 21 | p[2]

    def order(c):
        return {g: k for k, g in enumerate(sorted(c, key=lambda g: (-c[g], number(g)))[:ranks])}

    for k, (t, x) in enumerate(zip(texts, langs, strict=True)):
        if x and zlib.crc32(str(k).encode()) % 4 != 2:
            for g, n in grams(t).items():
                counts.setdefault(x, {})[g] = counts.setdefault(x, {}).get(g, 0) + n
    profiles = {x: order(c) for x, c in counts.items()}
    got = {r["doc_id"]: r for r in language.language_report(frame(spark, texts, langs=langs)).collect()}
    for k, t in enumerate(texts):
        doc = order(grams(t))
        apart = {x: sum(min(abs(p[g] - i), ranks) if g in p else ranks for g, i in doc.items()) for x, p in profiles.items()}
        best = min((d, x) for x, d in apart.items())
        want = (best[1], 1 - best[0] / (ranks * len(doc))) if doc else ("und", 0.0)
        assert got[k]["lang_pred"] == want[0] and abs(got[k]["score"] - want[1]) < 1e-12


def test_rank_distance_by_hand():
    p = language.Profiles({"aa": [5, 6, 7], "bb": [7, 6, 9]}, ranks=3)
    doc = np.array([5, 7, 8])
    assert p.distance("aa", doc) == 0 + 1 + 3
    assert p.distance("bb", doc) == 3 + 1 + 3


def plain_grams(text):
    out, clean = {}, "".join(c if c.isalpha() else " " for c in text.lower())
    for w in clean.split():
        s = f" {w} "
        for n in (1, 2, 3):
            for k in range(len(s) - n + 1):
                g = s[k : k + n]
                if g.strip() and (n < 3 or g[1] != " "):
                    out[g] = out.get(g, 0) + 1
    return sorted(out.values())


def test_gram_counts_equal_plain_counts():
    for t in ("abc abd", "a", "É é,x  yz!", prose(3, 50)):
        assert sorted(language.grams(t)[1].tolist()) == plain_grams(t)


def junk(k):
    r = random.Random(k)
    w = prose(k, 60).split()
    return [" | ".join(w), " ".join([r.choice(w)] * 80), " ".join(x.upper() + "!!" for x in w), " ".join(x + r.choice(["%%%", "&&&"]) for x in w)][k % 4]


def test_quality_on_held_out_rows(spark):
    n = 900
    good = [k % 6 != 0 for k in range(n)]
    docs = frame(spark, [prose(k, 30 + k % 90).capitalize() + "." if g else junk(k // 6) for k, g in enumerate(good)])
    labels = spark.createDataFrame([(k, int(g), 0) for k, g in enumerate(good) if k % 2], "doc_id long, quality int, toxic int")
    out = quality.quality_report(docs, labels).collect()
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k in range(n) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == good[r["doc_id"]] for r in held]) > 0.93
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in out)
    assert sorted(map(tuple, out)) == sorted(map(tuple, quality.quality_report(docs.repartition(7), labels).collect()))


def test_quality_of_odd_rows(spark):
    docs = frame(spark, odd_texts())
    labels = spark.createDataFrame([(5, 1), (5, 0), (6, None), (9, 1), (None, 1)], "doc_id long, quality int")
    out = quality.scored(docs, labels)
    assert out.count() == len(odd_texts()) and set(docs.columns) <= set(out.columns)
    assert out.where("score between 0 and 1 and predicted in (0, 1)").count() == len(odd_texts())
    nothing = quality.quality_report(docs, labels.limit(0)).agg(F.min("score"), F.max("score")).first()
    assert tuple(nothing) == (0.5, 0.5)
    assert quality.quality_report(docs.limit(0), labels).count() == 0
    assert quality.accepted(docs, labels).columns == docs.columns


def test_descent_reaches_the_least_non_negative_risk():
    """Against a plain descent on the risk as written down, with slopes by differences."""
    r = np.random.default_rng(3)
    p, u = (r.random((400, 6)) < q for q in (np.linspace(0.2, 0.8, 6), np.full(6, 0.5)))
    p, u, prior = p.astype(float), u.astype(float), 0.1  # so small that the second term stays above zero, where steps are plain descent
    loss = lambda z: np.logaddexp(0, -z).mean()

    def risk(w):
        zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        return prior * loss(zp) + max(0.0, loss(-zu) - prior * loss(-zp))

    plain = np.zeros(7)
    for _ in range(600):
        plain -= 0.5 * np.array([(risk(plain + 1e-5 * e) - risk(plain - 1e-5 * e)) / 2e-5 for e in np.eye(7)])
    w, bias = quality.descend(p, u, prior, seed=1, epochs=200, batch=100)
    assert abs(risk(np.append(w, bias)) - risk(plain)) < 0.01 < risk(np.zeros(7)) - risk(plain)


def test_scores_equal_a_plain_sum_of_weights(spark):
    docs = frame(spark, odd_texts() + [prose(k, 40) for k in range(30)])
    labels = spark.createDataFrame([(k, 1) for k in range(18, 48)], "doc_id long, quality int")
    model, _ = quality.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.quality_report(docs, labels).collect()}
    for k, t in enumerate(odd_texts() + [prose(k, 40) for k in range(30)]):
        z = model.bias
        for j, x in enumerate(quality.statistics(t)):
            z += model.weights[j * quality.BINS + sum(x >= e for e in model.edges[j])]
        assert abs(got[k] - 1 / (1 + np.exp(-z))) < 1e-9


def test_accepted_keeps_the_values_of_clashing_columns(spark):
    docs = spark.createDataFrame([(k, prose(k, 40), "mine", "a", 7) for k in range(40)], "doc_id long, text string, score string, `a.b` string, predicted int")
    labels = spark.createDataFrame([(k, 1) for k in range(40)], "doc_id long, quality int")
    out = quality.accepted(docs, labels)
    assert out.columns == docs.columns and {(r["score"], r["a.b"], r["predicted"]) for r in out.collect()} == {("mine", "a", 7)}


def test_class_prior_is_near_the_true_share():
    r = np.random.default_rng(5)
    for share in (0.3, 0.6, 0.9):
        bad = r.normal(-2, 1, 6000)
        u = np.where(r.random(6000) < share, r.normal(2, 1, 6000), bad)
        assert abs(quality.class_prior(r.normal(2, 1, 6000), u) - share) < 0.06


def test_licences_by_wording(spark):
    scanner = license_scan.Scanner()
    for name, text in license_scan.TEMPLATES.items():
        found = scanner.scan(f"Some words before.\n{text}\nand after")
        assert [(f[0], f[1], f[3]) for f in found] == [(1, name, 0)], name
    assert scanner.scan("This work is licensed under the GNU General Public License, version 4.") == []
    assert scanner.scan("He has a license to drive.") == []
    near = scanner.scan("This work is licenced under the GNU General Public License, version 3.")
    assert [(f[1], f[3], f[4]) for f in near] == [("GPL-3.0", 1, "licensed>licenced")]
    docs = frame(spark, odd_texts())
    got = {r["doc_id"]: r["licenses"] for r in license_scan.license_report(docs).collect()}
    assert got == {k: "MIT" if t and "MIT" in t else "" for k, t in enumerate(odd_texts())}
    assert license_scan.findings(docs).count() == 1
    assert license_scan.license_report(docs.limit(0)).count() == 0


def test_licences_inside_running_prose():
    scanner = license_scan.Scanner()
    for name, text in license_scan.TEMPLATES.items():
        for before, after in ((prose(1, 20), ""), ("", prose(2, 20)), (prose(3, 20), prose(4, 20))):
            found = scanner.scan(f"{before} {text} {after}")
            assert [(f[1], f[3]) for f in found] == [(name, 0)], (name, before, after)


def test_licences_over_line_ends_and_several_on_a_line():
    scanner = license_scan.Scanner()
    for name, text in license_scan.TEMPLATES.items():
        for width in (2, 4, 7):
            w = text.split(" ")
            wrapped = "\n".join(" ".join(w[k : k + width]) for k in range(0, len(w), width))
            found = scanner.scan(f"Some words before.\n{wrapped}\nand after")
            assert [(f[0], f[1], f[3]) for f in found] == [(1, name, 0)], (name, width)
    t = license_scan.TEMPLATES
    names = lambda x: [f[1] for f in scanner.scan(x)]
    assert names(f"{t['Apache-2.0']} {t['Proprietary']}") == ["Apache-2.0", "Proprietary"]
    assert names(f"{t['MIT']} {t['Apache-2.0']} {t['MIT']}") == ["MIT", "Apache-2.0", "MIT"]


def test_size_reductions_decide_between_templates_that_fit_alike(monkeypatch):
    """Templates that differ in a word or two confirm on each other's texts; the reduction names the right one."""
    scanner, t = license_scan.Scanner(), license_scan.TEMPLATES
    alike, texts = 0, {}
    for name, text in t.items():
        have = license_scan.words(f"{prose(1, 15)} {text} {prose(2, 15)}")
        rivals = {c[2] for c in scanner.confirmed(have)} - {name}
        alike += bool(rivals)
        texts[name] = f"{prose(1, 15)} {text} {prose(2, 15)}"
        assert [(f[1], f[3]) for f in scanner.scan(texts[name])] == [(name, 0)], (name, rivals)
    assert alike >= 3
    right = scanner.saved
    monkeypatch.setattr(scanner, "saved", lambda block, name: tuple(-x for x in right(block, name)))
    turned = [name for name, text in texts.items() if [f[1] for f in scanner.scan(text)] != [name]]
    monkeypatch.setattr(scanner, "saved", lambda block, name: (0, 0.0))
    flat = [name for name, text in texts.items() if [f[1] for f in scanner.scan(text)] != [name]]
    assert len(turned) >= 3 and flat


def test_no_verbatim_passage_is_lost_among_others():
    """Mixtures of templates in prose: each is found where it stands, whatever else is in the block."""
    scanner, t, r = license_scan.Scanner(), license_scan.TEMPLATES, random.Random(5)
    names = sorted(t)
    for k in range(40):
        chosen = [r.choice(names) for _ in range(r.randint(1, 4))]
        text = prose(7 * k, 12)
        for c in chosen:
            text += f"\n{t[c]}\n{prose(7 * k + 1, r.choice([0, 3, 12]))}"
        assert [(f[1], f[3]) for f in scanner.scan(text)] == [(c, 0) for c in chosen], chosen


def test_windows_of_long_blocks_find_what_one_block_does(monkeypatch):
    t, r = license_scan.TEMPLATES, random.Random(8)
    text = " ".join(f"license {prose(k, 40)} {t[r.choice(sorted(t))]}" for k in range(40))
    whole = [(f[1], f[3]) for f in license_scan.Scanner().scan(text)]
    monkeypatch.setattr(license_scan, "SPAN", 900)
    assert [(f[1], f[3]) for f in license_scan.Scanner().scan(text)] == whole and len(whole) >= 40


def least_differences(want, have):
    """The least number of differing words of any stretch of ``have``, by the plain recurrence, one word at a time."""
    never = 10**6
    row = [0] * (len(have) + 1)
    for w in want:
        new = [row[0] + (never if w.isdigit() else 1)]
        for j, t in enumerate(have, 1):
            replace = 0 if t == w else never if w.isdigit() or t.isdigit() else 1
            new.append(min(row[j - 1] + replace, row[j] + (never if w.isdigit() else 1), new[j - 1] + 1))
        row = new
    return min(row)


def test_every_template_within_the_bound_is_confirmed():
    """Against brute force: no anchor, block or ranking loses a passage, whatever words are changed."""
    scanner, r = license_scan.Scanner(), random.Random(11)
    for name, text in license_scan.TEMPLATES.items():
        for edits in (0, 1, 3, 8):
            w = text.split()
            for _ in range(min(edits, len(w) // 5)):
                k = r.randrange(len(w))
                w[k : k + r.choice([0, 1])] = [r.choice(["other", "the", "", "9"])]
            have = license_scan.words(prose(edits, 30) + " " + " ".join(w) + " " + prose(edits + 1, 30))
            best = {}
            for _, _, t, n, _, _ in scanner.confirmed(have):
                best[t] = min(n, best.get(t, n))
            for t in scanner.templates:
                if len(t.words) * len(have) < 12_000 or t.name == name:
                    least = least_differences(t.words, have)
                    assert best.get(t.name) == (least if least <= t.most else None), (name, t.name, edits)


def test_whole_licences_wrapped_numbered_and_in_very_long_texts():
    scanner, t = license_scan.Scanner(), license_scan.TEMPLATES
    names = lambda x: [f[1] for f in scanner.scan(x)]
    bsd = t["BSD-3-Clause-full"].replace("Redistributions of", "\n\n  1. Redistributions of").replace("Redistributions\nin", "\n  2. Redistributions in").replace("Neither", "\n  3. Neither")
    assert names(f"Copyright 2020 A. Person\n{bsd}\n") == ["BSD-3-Clause-full"]
    for name in ("MIT-full", "GPL-3.0-notice", "LGPL-2.1-notice", "BSD-2-Clause-full", "Apache-2.0-full"):
        w = t[name].split()
        assert names("\n".join(" * " + " ".join(w[k : k + 9]) for k in range(0, len(w), 9))) == [name]
    long = " license ".join(prose(k, 300) for k in range(30))
    assert names(f"{long} {t['MIT-full']} {long} {t['CC-BY-4.0']}") == ["MIT-full", "CC-BY-4.0"]
