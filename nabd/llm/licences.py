"""Fuzzy search for short notices: exact seeds by the pigeonhole principle, edits verified.

Texts and notices are compared as lower-case words joined by one space. A notice may occur with a
bounded number of edits (insertions, deletions, substitutions of a character), but its fixed words,
those that tell one licence from another, must stand as they are. Cut into one piece more than it
may have edits, every occurrence holds at least one piece unaltered. The pieces are looked up
exactly; around each hit, the `regex` library's bounded-error matching decides whether the whole
notice is there and with how many edits. A match is a run of whole words, reported as a word span.

Phrases are found without edits: places where their words stand consecutively.

Each text is worked on by itself, in the task that reads its row; work is linear in its length and
hits. Null and empty texts have no words and no matches. Repeated rows are answered repeatedly.
Extra columns are kept, except that columns named as the results are replaced. Empty tables give
empty results.
"""

import functools
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nabd.llm.common import slices


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    edits: int
    #: Words of the text that may not be edited.
    fixed: tuple[str, ...] = ()


# Phrases that give their label, and notices that give theirs with edits.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
NOTICES = (
    Notice("mit", "under the mit license", 3, ("mit",)),
    Notice("apache-2", "apache license version 2", 3, ("apache", "2")),
    Notice("apache-2", "apache license 2 0", 2, ("apache", "2", "0")),
    Notice("cc-by-nc", "cc by nc", 1, ("nc",)),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 3),
    Notice("gpl-3", "gnu general public license version 3", 3, ("3",)),
    Notice("mpl-2", "mozilla public license version 2", 3, ("2",)),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
)

#: Bytes as they are compared: A-Z in lower case, other ASCII but letters and digits as a space.
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)


def plain(text: bytes) -> list[bytes]:
    """The words of a text, lower-cased."""
    return text.translate(_PLAIN).split()


def _shares(edits: int, parts: int) -> list[tuple[int, ...]]:
    """All ways to share the edits between the parts, using every one of them."""
    if parts == 1:
        return [(edits,)]
    return [(k, *rest) for k in range(edits + 1) for rest in _shares(edits - k, parts - 1)]


@functools.cache
def _compiled(notice: Notice) -> tuple[regex.Pattern, tuple[tuple[int, str], ...]]:
    """The pattern of a notice, and its pieces with their places; both with a space at each end."""
    runs: list[tuple[bool, list[str]]] = []
    for word in notice.text.split():
        fixed = word in notice.fixed
        if not runs or runs[-1][0] != fixed:
            runs.append((fixed, []))
        runs[-1][1].append(word)
    free = sum(not fixed for fixed, _ in runs)
    forms = []
    for share in _shares(notice.edits, free) if free else [()]:
        left = iter(share)
        parts = []
        for fixed, run in runs:
            body = regex.escape(" ".join(run))
            parts.append(body if fixed else f"(?:{body}){{e<={next(left)}}}")
        forms.append(" " + " ".join(parts) + " ")
    pattern = regex.compile("(?b)(?:" + "|".join(forms) + ")")
    whole = f" {notice.text} "
    cuts = [len(whole) * i // (notice.edits + 1) for i in range(notice.edits + 2)]
    return pattern, tuple((a, whole[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))


def candidates(text: str, notice: Notice) -> list[tuple[int, int]]:
    """Ranges of the text, each around one exact piece, that hold every occurrence of the notice."""
    reach = len(notice.text) + 2 + notice.edits
    found = set()
    for place, piece in _compiled(notice)[1]:
        at = text.find(piece)
        while at >= 0:
            found.add((max(0, at - place - notice.edits), at - place + reach))
            at = text.find(piece, at + 1)
    return sorted(found)


def matches(words: list[bytes], notices=NOTICES) -> list[tuple[Notice, int, int, int]]:
    """(notice, edits, first word, word after the last) of what is found, by place.

    Of matches of one notice that share words, the one with fewer edits is reported.
    """
    text = f" {b' '.join(words).decode()} "
    found = []
    for rank, notice in enumerate(notices):
        pattern, own = _compiled(notice)[0], []
        for low, high in candidates(text, notice):
            if hit := pattern.search(text, low, high):
                own.append((hit.start(), hit.end(), rank, sum(hit.fuzzy_counts)))
        kept: list[tuple[int, int, int, int]] = []
        for match in sorted(own):
            if kept and match[0] < kept[-1][1] - 1:  # one space may end a match and begin the next
                kept[-1] = min(kept[-1], match, key=lambda m: m[3])
            else:
                kept.append(match)
        found += kept
    out, word, at = [], 0, 0
    for start, end, rank, edits in sorted(found):
        word, at = word + text.count(" ", at, start), start
        out.append((notices[rank], edits, word, word + text.count(" ", start, end) - 1))
    return out


def phrase_places(words: list[bytes], phrases=PHRASES) -> list[tuple[str, int]]:
    """(label, first word) of every place where a phrase's words stand consecutively."""
    text = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in phrases:
        sought = f" {phrase} ".encode()
        at = text.find(sought)
        while at >= 0:
            found.append((at, label))
            at = text.find(sought, at + 1)
    out, word, at = [], 0, 0
    for start, label in sorted(found):
        word, at = word + text.count(b" ", at, start), start
        out.append((label, word))
    return out


def with_notices(
    docs: DataFrame,
    notices: tuple[Notice, ...] = NOTICES,
    phrases: tuple[tuple[str, str], ...] = PHRASES,
    text: str = "text",
) -> DataFrame:
    """The documents with `n_words`, `places` of phrases (label, word) and `notices` found with at most
    their edits: label, edits, start and end in words, and score (1 less edits by length)."""
    names = ("n_words", "places", "notices")
    kept = docs.drop(*[c for c in docs.columns if c.lower() in names])
    added = (
        "n_words long, places array<struct<label:string, word:long>>, "
        "notices array<struct<label:string, edits:int, start:long, end:long, score:double>>"
    )
    schema = StructType(kept.schema.fields + StructType.fromDDL(added).fields)
    place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    fields = [("label", pa.string()), ("edits", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]
    notice_type = pa.list_(pa.struct([*fields, ("score", pa.float64())]))

    def found_in(words):
        return [
            {
                "label": notice.label,
                "edits": edits,
                "start": start,
                "end": end,
                "score": max(0.0, 1.0 - edits / len(notice.text)),
            }
            for notice, edits, start, end in matches(words, notices)
        ]

    def batches(rows):
        for batch in slices(rows):
            texts = [plain(t or b"") for t in batch.column(text).cast(pa.binary()).to_pylist()]
            places = [[{"label": a, "word": w} for a, w in phrase_places(t, phrases)] for t in texts]
            columns = [
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array(places, place),
                pa.array([found_in(t) for t in texts], notice_type),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema.names)

    return kept.mapInArrow(batches, schema)


def digest(docs: DataFrame) -> DataFrame:
    """Places of phrases, the labels they give, all labels, and the score of the best match."""
    found = with_notices(docs.select("doc_id", "text"))
    label, start = F.col("places.label"), F.col("places.word")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max("notices.score"), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"),
        F.array_max(start).alias("last_word"),
        joined(label).alias("base_labels"),
        joined(F.concat(label, F.col("notices.label"))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
        F.size("notices").cast("long").alias("n_notices"),
    )
