"""Text functions as Column expressions; greedy scans that SQL can't express are Arrow pandas UDFs."""

from __future__ import annotations

from itertools import compress, count, islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Phrases that make a transcript meaningless (fixed values).
MEANINGLESS = (
    "thank you for watching",
    "thanks for watching",
    "like and subscribe",
    "music playing",
    "applause",
    "laughter",
    "um um um",
    "uh uh uh",
    "ah ah ah",
)
#: Filler words (fixed values).
FILLERS = ("uh", "um", "er", "ah", "oh", "hm", "hmm", "uhh", "umm", "err", "ahh", "ohh")
#: Contractions without their apostrophe, repaired in this order (fixed values).
CONTRACTIONS = ("cant", "wont", "dont", "doesnt", "didnt", "wouldnt", "couldnt", "shouldnt", "isnt", "arent", "wasnt", "werent", "hasnt", "havent", "hadnt")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, not again for each element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(c: Column | str) -> Column:
    """Words at white space, without empty ones."""
    return F.filter(F.split(col(c), r"\s+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def split_count(c: Column | str) -> Column:
    """Pieces at white space, empty ones at the ends included: a blank text counts as one or two."""
    return F.size(F.split(col(c), r"\s+"))


def trimmed(c: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def contains_literal(c: Column | str, term: str) -> Column:
    """Whether the text contains the term, in any case; wildcards mean themselves."""
    return F.lower(col(c)).contains(term.lower())


def snippet(c: Column | str, term: str, around: int = 100) -> Column:
    """The first match with `around` characters on each side, '...' where something is left out."""
    c = col(c)
    at = F.instr(F.lower(c), term.lower())
    first = F.greatest(at - around, F.lit(1))
    last = F.least(at + len(term) - 1 + around, F.length(c))
    return F.concat(F.when(first > 1, "...").otherwise(""), F.substring(c, first, last - first + 1), F.when(last < F.length(c), "...").otherwise(""))


def chunk_starts(length: Column, size: int, overlap: int) -> Column:
    """Starts (from 0) of fixed chunks: every size - overlap characters."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the chunk")
    return F.when(length > 0, F.sequence(F.lit(0), length - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))


def fixed_chunks(c: Column | str, size: int, overlap: int) -> Column:
    c = col(c)
    return F.transform(chunk_starts(F.length(c), size, overlap), lambda s: F.substring(c, s + 1, F.lit(size)))


def token_estimate(c: Column | str) -> Column:
    """ceil(0.35 * characters), in whole numbers."""
    return F.ceil(F.length(col(c)) * 35 / F.lit(100)).cast("long")


def boundary_chunks(c: Column | str, size_tokens: int, overlap_tokens: int) -> Column:
    """Chunks that end after the last '. ' or else the last space; starts advance by a fixed step whatever was trimmed."""
    c = col(c)
    size, overlap = -(-size_tokens * 100 // 35), -(-overlap_tokens * 100 // 35)
    step, n = max(size - overlap, 1), F.length(c)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / F.lit(step)).cast("int"), F.lit(0)) * step, F.lit(step)))

    def piece(s: Column) -> Column:
        raw = F.substring(c, s + 1, F.lit(size))
        back = F.reverse(raw)
        period, space = F.instr(back, " ."), F.instr(back, " ")
        keep = F.when(s + size >= n, F.length(raw)).when(period > 0, F.length(raw) - period + 1).when(space > 0, F.length(raw) - space + 1).otherwise(F.length(raw))
        return F.substring(raw, F.lit(1), keep)

    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, piece))


def clean_markdown(c: Column | str) -> Column:
    """Without reasoning blocks and without one code fence around everything."""
    t = trimmed(F.regexp_replace(col(c), r"(?s)<think(?:ing)?>.*?</think(?:ing)?>", ""))
    fenced = lambda head: trimmed(F.substring(t, F.lit(len(head) + 1), F.length(t) - len(head) - 3))
    opens = lambda head: t.startswith(head) & t.endswith("```") & (F.length(t) >= len(head) + 3)
    first, second = "```markdown\n", "```\n"
    return F.when(opens(first), fenced(first)).when(opens(second), fenced(second)).otherwise(t)


def first_title(c: Column | str) -> Column:
    """The first line that starts with '# ', without its marks; null if there is none."""
    found = F.regexp_extract(col(c), r"(?m)^(# [^\n]*)$", 1)
    return F.when(found != "", trimmed(F.regexp_replace(found, r"^(?:# )+", "")))


def without_title(c: Column | str) -> Column:
    """What follows the line of the first '#', without white space at its start; unchanged where there is no title."""
    c = col(c)
    at = F.instr(c, "#")
    line_end = F.instr(F.substring(c, at, F.length(c)), "\n")
    rest = F.when(line_end > 0, F.substring(c, at + line_end - 1, F.length(c))).otherwise("")
    return F.when(F.coalesce(first_title(c), F.lit("")) == "", c).otherwise(F.regexp_replace(rest, r"^\s+", ""))


def is_meaningless(c: Column | str) -> Column:
    """One of the phrases, or at most three different characters in over ten bytes."""
    c = col(c)
    phrase = F.lower(c).rlike("|".join(MEANINGLESS))
    few = lambda c: F.size(F.array_distinct(F.split(c, ""))) <= 3
    # nearly all texts have four different characters among the first
    return phrase | (F.when(few(F.left(c, F.lit(64))), few(c)).otherwise(False) & (F.octet_length(c) > 10))


def collapse_repeats(ws: Column) -> Column:
    """Words that repeat the one before them are dropped."""
    before = F.concat(F.array(F.lit("")), F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0))))
    return F.filter(F.zip_with(ws, before, lambda w, b: F.when(w != b, w)), lambda w: w.isNotNull())


def repetition_ratio(c: Column | str) -> Column:
    """Share of words that occurred before, in any case; 0 below four words."""

    def ratio(ws: Column) -> Column:
        low = F.transform(ws, lambda w: F.lower(w))
        return F.when(F.size(ws) < 4, 0.0).otherwise((F.size(ws) - F.size(F.array_distinct(low))) / F.size(ws))

    return let(words(c), ratio)


def remove_fillers(c: Column | str) -> Column:
    bare = lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}]+|[^\p{L}]+$", "")
    return F.array_join(F.filter(words(c), lambda w: ~bare(w).isin(*FILLERS)), " ")


def normalize_punctuation(c: Column | str) -> Column:
    """No space before marks, one after the end of a sentence, a capital at the start."""
    t = trimmed(c)
    for mark in ".,?!":
        t = F.replace(t, F.lit(" " + mark), F.lit(mark))
    for mark in ".?!":
        t = F.replace(t, F.lit(mark + "  "), F.lit(mark + " "))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))


def fix_contractions(c: Column | str) -> Column:
    """Apostrophes put back wherever the letters stand, inside of words too."""
    t = col(c)
    for word in CONTRACTIONS:
        t = F.replace(t, F.lit(word), F.lit(word[:-1] + "'t"))
    return t


def sanitize_name(c: Column | str) -> Column:
    return trimmed(F.regexp_replace(col(c), r'[/\\:*?"<>|\p{Cntrl}]', "_"))


def strip_meeting_affix(c: Column | str) -> Column:
    """The bare name of a meeting title in the forms that browsers show."""
    c = col(c)
    after = lambda prefix: F.substring(c, F.lit(len(prefix) + 1), F.length(c))
    parts = F.split(c, "—")
    return (
        F.when(c.startswith("Meet - "), trimmed(after("Meet - ")))
        .when(c.startswith("Google Meet - Meet "), F.when(F.size(parts) > 1, trimmed(F.get(parts, F.lit(1)))).otherwise(c))
        .when(c.startswith("Meet – "), trimmed(F.substring_index(after("Meet – "), " and ", 1)))
        .when(c.endswith(" - Google Meet"), trimmed(F.substring(c, F.lit(1), F.length(c) - len(" - Google Meet"))))
        .otherwise(c)
    )


def format_mmss(seconds: Column | str, fallback: Column | None = None) -> Column:
    """[MM:SS] with unbounded minutes; null gives the fallback."""
    s = F.floor(col(seconds)).cast("long")
    text = F.format_string("[%02d:%02d]", F.floor(s / 60).cast("long"), s % 60)
    return F.when(col(seconds).isNull(), fallback if fallback is not None else F.lit(None)).otherwise(text)


def format_hms(seconds: Column | str) -> Column:
    s = F.floor(col(seconds)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), s % 60)


def format_size(size: Column | str) -> Column:
    n = col(size)
    shown = lambda unit, name: F.concat(F.format_string("%.1f", F.bround(n / F.lit(float(unit)), 1)), F.lit(" " + name))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, shown(1024, "KB")).when(n < 1024**3, shown(1024**2, "MB")).otherwise(shown(1024**3, "GB"))


def section_key(title: Column | str) -> Column:
    return F.replace(F.replace(F.lower(col(title)), F.lit(" & "), F.lit("_")), F.lit(" "), F.lit("_"))


def format_prompt(name: Column, templates: dict[str, str], system: Column, user: Column) -> tuple[Column, Column]:
    """(prompt, problem): the named template with its two places filled, the system's first; other names are a problem."""
    prompt = F.lit(None).cast("string")
    for known, text in templates.items():
        filled = F.replace(F.replace(F.lit(text), F.lit("{system_prompt}"), system), F.lit("{user_prompt}"), user)
        prompt = F.when(name == known, filled).otherwise(prompt)
    return prompt, F.when(~name.isin(*templates), F.concat(F.lit("Unknown template: "), name))


#: White space between subword tokens and what of it stays (fixed value).
TOKEN_SPACE = r"(?U)\A\s|\s\B|(\s)\b"


def join_tokens(tokens: Column) -> Column:
    """Subword tokens put together; white space stays, as one space, where a word follows it and not at the start."""
    return F.regexp_replace(F.array_join(tokens, ""), TOKEN_SPACE, "$1")


def collapsed_older(ws: list[str]) -> list[str]:
    """Runs of a word and of a pair of words are kept once; a pair that ends the text stays after its run."""
    out, i, n = [], 0, len(ws)
    while i < n:
        end = next((j for j in range(i + 1, n) if ws[j] != ws[i]), n)
        pair = ws[i : i + 2]
        if end > i + 1:
            out.append(ws[i])
            i = end
        elif i + 3 < n and pair == ws[i + 2 : i + 4]:
            out += pair
            i += 4
            while i + 2 < n and ws[i : i + 2] == pair:
                i += 2
        else:
            out.append(ws[i])
            i += 1
    return out


@F.pandas_udf(T.StringType())
def collapse_older(texts: pd.Series) -> pd.Series:
    """`collapsed_older` of the text's words; texts of less than four words stay as they are, null stays null."""
    return texts.map(lambda t: t if t is None or len(t.split()) < 4 else " ".join(collapsed_older(t.split())), na_action="ignore")


def post_process(c: Column | str, partial: Column) -> Column:
    """struct(text, confidence): repeats and fillers go, marks are put right and, in what isn't partial, contractions.

    Texts of less than three bytes stay; a text that can't be processed comes back at confidence 0.5.
    """
    c = col(c)
    clean = normalize_punctuation(remove_fillers(collapse_older(c)))
    done = F.when(partial, clean).otherwise(fix_contractions(clean))
    text = F.when(F.octet_length(trimmed(c)) < 3, c).otherwise(done)
    return F.struct(F.coalesce(text, c).alias("text"), F.when(text.isNull(), 0.5).when(partial, 0.8).otherwise(0.95).alias("confidence"))


def collapsed_phrases(ws: list[str]) -> list[str]:
    """Phrases of two to five words that follow themselves are kept once; one pass, no second look."""
    if len(ws) < 4:
        return ws
    # a phrase that follows itself has its first word again so many words later; places without that are not looked at
    sizes: dict[int, list[int]] = {}
    for n in range(2, 6):
        for i in compress(count(), map(eq, ws, islice(ws, n, None))):
            sizes.setdefault(i, []).append(n)
    out, done = [], 0
    for i in sorted(sizes):
        if i >= done and (size := next((n for n in sizes[i] if i + 2 * n <= len(ws) and ws[i : i + n] == ws[i + n : i + 2 * n]), 0)):
            out += ws[done : i + size]
            done = i + 2 * size
    return out + ws[done:]


@F.pandas_udf(T.StringType())
def collapse_phrases(texts: pd.Series) -> pd.Series:
    """`collapsed_phrases` of the text's words, joined by spaces; null stays null."""
    return texts.map(lambda t: None if t is None else " ".join(collapsed_phrases(t.split())), na_action="ignore")


def clean_repetitive(c: Column | str) -> Column:
    """Junk becomes ''; under three words nothing changes; repeats go; what still repeats over 70 % becomes ''."""
    c = col(c)
    short = F.array_join(let(words(c), collapse_repeats), " ")
    done = collapse_phrases(short)
    return F.when(is_meaningless(c), "").when(word_count(c) < 3, c).when(repetition_ratio(done) > 0.7, "").otherwise(done)


def stitched(before: str, after: str) -> str:
    """Two transcripts joined at their longest common run of words (lower case, without ASCII punctuation)."""
    bare = str.maketrans("", "", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    a, b = before.split(), after.split()
    numbers: dict[str, int] = {}
    x, y = (np.array([numbers.setdefault(w.lower().translate(bare), len(numbers)) for w in ws], int) for ws in (a, b))
    best, at, to, last = 0, 0, 0, np.zeros(len(y) + 1, int)
    for i, u in enumerate(x if len(y) else ()):
        # length of the common run that ends at the word and each word of y
        now = np.concatenate([[0], np.where(y == u, last[:-1] + 1, 0)])
        j = int(now.argmax())
        if now[j] > best:
            best = int(now[j])
            at, to = i + 1 - best, j - best
        last = now
    return " ".join(a + b) if not best else " ".join(a[:at] + b[to:])


@F.pandas_udf(T.StringType())
def stitch(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else stitched(a, b) for a, b in zip(before, after)])
