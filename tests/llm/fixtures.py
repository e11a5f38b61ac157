"""Small document tables with everything that goes wrong in large ones, and plain versions of the contracts."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_lines string, h string, `a.b` string, h2 int"


def rows(texts, ids=None, langs=None):
    ids = ids or range(len(texts))
    return [(i, t, langs[k] if langs else "en", "src0", len(t or ""), "old", "old", "h", "dot", 1) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


def frame(spark, texts, ids=None, langs=None):
    return spark.createDataFrame(rows(texts, ids, langs), SCHEMA)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def odd_texts():
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    return [
        None, "", "   \n\t ", "one", "Two words", base, base, base.upper(), " ".join(near), base + "\nThe same long line here.\n\n",
        "the same LONG line here.  \nsomething of its own to keep\nthe same long line here.", "short\nshort\nshort", "é ß 日本語   x\r\ny",
        prose(2, 6000), "x" * 5000, "!!! ??? 123 456", "a\0b c", "Released under the MIT License.\n" + prose(3, 30),
    ]


def lower_ascii(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def split_words(t, pattern):
    return re.findall(pattern, lower_ascii(t))
