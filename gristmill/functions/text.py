"""Text features as column expressions; all of them run inside the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that speak in the first person, and hedges.
FIRST_PERSON = ("i", "i'm", "i'd", "i'll", "i've", "me", "my", "mine", "myself", "we", "our")
HEDGES = ("perhaps", "maybe", "might", "possibly", "likely")
#: Word lists of the seventeen shape features.
SPEAKER, LISTENER = ("i", "me", "my", "mine", "myself"), ("you", "your", "yours", "yourself")
DOUBTS = ("perhaps", "maybe", "might", "could", "possibly", "seems", "somewhat")


def matches(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).cast("long")


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part)))) / len(part)).cast("long")


def without_reasoning(text: Column) -> Column:
    """Without the blocks in which a model thinks aloud."""
    for tag in ("think", "thinking", "reasoning"):
        text = F.regexp_replace(text, rf"(?is)<{tag}>.*?</{tag}>", "")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def markdown(text: Column) -> dict[str, Column]:
    return {
        "n_chars": F.length(text).cast("long"),
        "headers": matches(text, r"(?m)^\s*#{1,6}\s+"),
        "bold": matches(text, r"\*\*\S(?:.*?\S)??\*\*") + matches(text, r"__\S(?:.*?\S)??__"),
        "lists": matches(text, r"(?m)^\s*[-*+]\s+") + matches(text, r"(?m)^\s*\d+[.)]\s+"),
    }


def shape(text: Column) -> dict[str, Column]:
    return {
        "sentences": F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: F.trim(s) != "")).cast("long"),
        "n_words": F.size(words(text)).cast("long"),
        "paragraphs": F.size(F.filter(F.split(text, r"\n\s*\n"), lambda s: F.trim(s) != "")).cast("long"),
        "code_blocks": F.floor(occurrences(text, "```") / 2).cast("long"),
        "inline_code": matches(text, r"`[^`]+`"),
        "quotes": matches(text, r"(?m)^\s*>"),
        "bangs": occurrences(text, "!"),
        "questions": occurrences(text, "?"),
        "newlines": occurrences(text, "\n"),
        "dashes": occurrences(text, "—") + occurrences(text, "--"),
        "capitals": matches(text, r"[A-Z]{3,}"),
    }


def person_rate(text: Column, words_: tuple = FIRST_PERSON) -> Column:
    """Share of first-person words among words of letters and apostrophes; null if there are none."""
    tokens = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z']+"), F.lit(0)), F.lower)
    return F.size(F.filter(tokens, lambda w: w.isin(*words_))) / F.nullif(F.size(tokens), F.lit(0))


def canonical(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def judged(label: Column) -> Column:
    """A free label as correct, incorrect or partial: exact words first, then the first part that occurs, in this
    order, by which 'incorrect ...' with more words counts as correct (as such labels are read in the data)."""
    low = F.lower(F.trim(label))
    return F.when(low.isin("correct", "incorrect", "partial"), low).when(low.contains("partial"), "partial").when(low.contains("correct"), "correct").when(low.contains("wrong"), "incorrect")


def chunks(tokens: Column, size: int, overlap: int, least: int) -> Column:
    """Overlapping slices of a token array; a short one at the end is left out unless it is the only one."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)), F.lit(size - overlap))
    cut = F.transform(starts, lambda s: F.slice(tokens, s + 1, size))
    return F.filter(cut, lambda c, i: (i == 0) | (F.size(c) >= least))


def many_counters(text: Column) -> dict[str, Column]:
    """Counts of marks beyond ``markdown`` and ``shape``: table rows, emoji, fences."""
    return {
        "table_rows": matches(text, r"(?m)^\s*\|.*\|\s*$"),
        "emoji": matches(text, r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"),
        "links": matches(text, r"\[[^\]]+\]\([^)]+\)"),
    }


def rate_parts(text: Column) -> dict[str, Column]:
    """What several of ``word_rates`` rest on: selected first, each is found once a text."""
    return {
        "found": F.regexp_extract_all(text, F.lit(r"(?U)\b\w+\b"), F.lit(0)),
        "ends": matches(text, r"[.!?]+"),
        "bolds": matches(text, r"\*\*\S(?:.*?\S)??\*\*"),
    }


def word_rates(text: Column, parts: dict[str, Column] | None = None) -> dict[str, Column]:
    """Seventeen numbers of a text's shape: lengths, and rates by word, hundred words, thousand words and sentence.
    ``parts``: columns that hold ``rate_parts`` of the text."""
    parts = parts or rate_parts(text)
    found, bold = parts["found"], parts["bolds"]
    n = F.size(found).cast("double")
    sentences = F.greatest(F.lit(1), parts["ends"] + 1).cast("double")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    among = lambda words_: F.size(F.filter(found, lambda w: F.lower(w).isin(*words_)))
    per = lambda x, unit: F.when(n > 0, x * unit / n).otherwise(0.0)
    return {
        "n_words": n,
        "n_sentences": sentences,
        "words_a_sentence": n / sentences,
        "mean_word": F.when(n > 0, F.aggregate(F.transform(found, F.length), F.lit(0), lambda a, b: a + b) / n).otherwise(0.0),
        "unique_share": per(F.size(F.array_distinct(F.transform(found, F.lower))), 1),
        "lines_per_100w": per(F.size(lines), 100),
        "headers_per_1kw": per(markdown(text)["headers"], 1000),
        "bold_per_1kw": per(bold, 1000),
        "italic_per_1kw": per(F.floor(F.greatest(F.lit(0), occurrences(text, "*") - 4 * bold) / 2), 1000),
        "lists_per_1kw": per(markdown(text)["lists"], 1000),
        "hedges_per_1kw": per(among(HEDGES), 1000),
        "persons_per_1kw": per(among(tuple(w for w in FIRST_PERSON if "'" not in w)), 1000),
        "dashes_per_1kw": per(occurrences(text, "—") + occurrences(text, "--"), 1000),
        "ellipses_per_1kw": per(matches(text, r"\.\.\.|…"), 1000),
        "bangs_a_sentence": occurrences(text, "!") / sentences,
        "questions_a_sentence": occurrences(text, "?") / sentences,
        "capitals_per_100w": per(F.size(F.filter(found, lambda w: (F.length(w) > 2) & w.rlike("^[A-Z]+$"))), 100),
    }


def shape_features(text: Column) -> dict[str, Column]:
    """Seventeen numbers on a text's shape: counts, and rates by word or sentence, by 100 or by 1000 words. A word is
    a run of letters, digits and underscores of any script, a sentence ends with marks before a blank."""
    w = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    n, s = F.size(w).cast("double"), (matches(text, r"[.!?]+\s") + 1).cast("double")
    low = F.transform(w, F.lower)
    any_of = lambda words_: F.size(F.filter(low, lambda x: x.isin(*words_)))
    words_, stars, bold = F.greatest(F.lit(1.0), n), occurrences(text, "*"), F.floor(occurrences(text, "**") / 2)
    loud = F.size(F.filter(w, lambda x: (F.length(x) > 2) & (F.upper(x) == x) & (F.lower(x) != x)))
    return {
        "char_count": F.length(text).cast("double"), "word_count": n, "newlines": occurrences(text, "\n").cast("double"), "sentence_count": s, "avg_sentence_words": n / s,
        "first_person_rate": any_of(SPEAKER) / words_, "second_person_rate": any_of(LISTENER) / words_, "hedge_rate": any_of(DOUBTS) / words_,
        "question_rate": occurrences(text, "?") / s, "exclamation_rate": occurrences(text, "!") / s,
        "em_dashes_per_100w": 100 * (occurrences(text, "—") + occurrences(text, "--")) / words_, "ellipses_per_100w": 100 * (occurrences(text, "…") + occurrences(text, "...")) / words_,
        "bullet_lines_per_1kw": 1000 * matches(text, r"(?m)^\s*[-*•]\s") / words_, "numbered_lines_per_1kw": 1000 * matches(text, r"(?m)^\s*\d+[.)]\s") / words_,
        "bold_markers_per_1kw": 1000 * bold / words_, "italic_markers_per_1kw": 1000 * F.floor(F.greatest(F.lit(0), stars - 2 * bold) / 2) / words_,
        "all_caps_words_per_1kw": 1000 * loud / words_,
    }


def line_statistics(text: Column) -> dict[str, Column]:
    """Fifteen numbers of words, lines and characters."""
    w, lines = words(text), F.split(text, "\n")
    n, m, c = F.size(w).cast("double"), F.size(lines).cast("double"), F.length(text).cast("double")
    long_ = F.transform(lines, F.length)
    letters = F.aggregate(F.transform(w, F.length), F.lit(0), lambda a, b: a + b)
    share = lambda x, of: F.when(of > 0, x / of).otherwise(0.0)
    return {
        "chars": c, "words": n, "lines": m,
        "mean_word": share(letters, n),
        "unique_words": share(F.size(F.array_distinct(F.transform(w, F.lower))), n),
        "longest_word": F.coalesce(F.array_max(F.transform(w, F.length)), F.lit(0)).cast("double"),
        "longest_line": F.array_max(long_).cast("double"),
        "mean_line": share(c, m),
        "short_lines": share(F.size(F.filter(long_, lambda x: x < 40)), m),
        "empty_lines": share(F.size(F.filter(lines, lambda x: F.trim(x) == "")), m),
        "digits": share(matches(text, "[0-9]"), c),
        "capitals": share(matches(text, "[A-Z]"), c),
        "commas": share(occurrences(text, ","), n),
        "colons": share(occurrences(text, ":") + occurrences(text, ";"), n),
        "brackets": share(occurrences(text, "(") + occurrences(text, ")"), n),
    }


def first_word_label(reply: Column) -> Column:
    """Correct, Incorrect or Partially by a reply's first word; null for any other."""
    word = F.initcap(F.regexp_extract(F.trim(reply), r"^([A-Za-z]+)", 1))
    return F.when(word.isin("Correct", "Incorrect", "Partially"), word)


def percent(text: Column) -> Column:
    """The first percentage of a text."""
    return F.regexp_extract(text, r"([\d.]+)%", 1).try_cast("double")


def money(text: Column) -> Column:
    """A number without currency signs, thousands marks and warnings."""
    return F.trim(F.regexp_replace(text, r"[$,]|WARN", "")).try_cast("double")


def tagged(text: Column, tag: str, without: tuple[str, ...] = ()) -> Column:
    """What stands in a tag, without other tags in it and their contents; null if the tag is missing."""
    inside = F.when(text.rlike(rf"(?is)<{tag}>.*?</{tag}>"), F.regexp_extract(text, rf"(?is)<{tag}>(.*?)</{tag}>", 1))
    for other in without:
        inside = F.regexp_replace(inside, rf"(?is)<{other}>.*?</{other}>", "")
    return F.trim(inside)


def headed(text: Column, headings: tuple[str, ...]) -> dict[str, Column]:
    """The sections under these headings, in this order; null where a heading is missing."""
    out = {}
    for k, h in enumerate(headings):
        rest = "|".join(headings[k + 1 :])
        end = rf"(?=^\s*#*\s*(?:{rest})\s*:?\s*$|\z)" if rest else r"\z"
        pattern = rf"(?ism)^\s*#*\s*{h}\s*:?\s*$(.*?){end}"
        out[h] = F.when(text.rlike(pattern), F.regexp_replace(F.regexp_extract(text, pattern, 1), r"^\s+|\s+$", ""))
    return out


def shortened(text: Column, most: int, mark: str = " [truncated]") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)
