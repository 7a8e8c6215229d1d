"""Notices with edits against an edit-distance table over every run of whole words."""

import functools
import random
import re

import pytest

from nabd.llm import licences
from nabd.llm.licences import NOTICES, PHRASES, Notice


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        after = [i]
        for j, y in enumerate(b, 1):
            after.append(min(row[j] + 1, after[j - 1] + 1, row[j - 1] + (x != y)))
        row = after
    return row[-1]


def edits_of(span, notice):
    """The fewest edits that turn the notice into the span, its fixed words left alone."""
    parts = []
    for word in notice.text.split():
        if parts and parts[-1][0] == (word in notice.fixed):
            parts[-1][1].append(word)
        else:
            parts.append((word in notice.fixed, [word]))
    parts = [(fixed, " ".join(run)) for fixed, run in parts]

    @functools.cache
    def best(i, rest):
        fixed, part = parts[i]
        if i == len(parts) - 1:
            return (0 if rest == part else 99) if fixed else distance(part, rest)
        ends = [m.start() for m in re.finditer(" ", rest)]
        costs = [((0 if rest[:e] == part else 99) if fixed else distance(part, rest[:e]), e) for e in ends]
        return min((cost + best(i + 1, rest[e + 1 :]) for cost, e in costs if cost < 99), default=99)

    return best(0, span)


def fewest(words, notice):
    spans = (" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, min(len(words), i + 14) + 1))
    near = (s for s in spans if abs(len(s) - len(notice.text)) <= notice.edits)
    return min((edits_of(s, notice) for s in near), default=99)


def altered(rng, text, times):
    text = list(text)
    for _ in range(times):
        at, letter, what = rng.randrange(len(text)), rng.choice("abeilmst 2ncé"), rng.random()
        if what < 0.3:
            text.insert(at, letter)
        elif what < 0.6:
            text[at] = letter
        else:
            del text[at]
    return "".join(text)


def some_text(rng):
    parts = []
    for _ in range(rng.randint(0, 2)):
        notice = rng.choice(NOTICES)
        parts += [rng.choice(["the", "under", "mit", "2", "license"]) for _ in range(rng.randint(0, 3))]
        parts.append(altered(rng, notice.text, rng.randint(0, notice.edits + 2)))
    return " ".join(parts)


def test_every_notice_within_its_edits_is_found():
    rng = random.Random(4)
    hits = 0
    for _ in range(300):
        words = licences.plain(some_text(rng).encode())
        for notice in NOTICES:
            want = fewest([w.decode() for w in words], notice)
            got = licences.matches(words, (notice,))
            assert bool(got) == (want <= notice.edits), (notice, words)
            for _, edits, start, end in got:
                assert edits == edits_of(b" ".join(words[start:end]).decode(), notice)
            if got:
                hits += 1
                assert min(edits for _, edits, _, _ in got) == want
    assert hits > 100


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the MIT licence.", ["mit"]),
        ("under the MPL license", []),  # two edits away, in a fixed word
        ("under\nthe--M I T license", []),
        ("Apache Lisence, Verson 2.0", ["apache-2"]),
        ("Apache License, Version 1.1", []),
        ("CC BY-ND 4.0", []),
        ("C BY-NC", ["cc-by-nc"]),
        ("Creative Commons Attribution-Non-Commercial", ["cc-by-nc"]),
        ("GNU Lesser General Public License, version 3", []),
        ("gnu genral public licence version 3", ["gpl-3"]),
    ],
)
def test_what_tells_licences_apart(text, labels):
    found = licences.matches(licences.plain(text.encode()))
    assert sorted({notice.label for notice, *_ in found}) == labels


def test_very_long_and_repeated_notices():
    words = licences.plain(b"under the mit licence " * 20000)
    found = licences.matches(words)
    assert [start for _, _, start, _ in found] == list(range(0, 80000, 4))
    assert {edits for _, edits, _, _ in found} == {1}
    shared = licences.phrase_places(licences.plain(b"cc by nc cc by nc by nc"))
    assert [word for _, word in shared] == [0, 3]


def digest_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in PHRASES:
        parts = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    fuzzy = [(fewest(words, n), n) for n in NOTICES]
    fuzzy = [(k, n) for k, n in fuzzy if k <= n.edits]
    base = {label for _, label in places}
    score = 1.0 if places else max((1 - k / len(n.text) for k, n in fuzzy), default=0.0)
    starts = [i for i, _ in places]
    return (
        len(words),
        len(places),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(base)),
        ",".join(sorted(base | {n.label for _, n in fuzzy})),
        pytest.approx(score),
    )


def test_digest(spark):
    rng = random.Random(9)
    texts = [some_text(rng) for _ in range(120)] + [None, "", " \n.", "É MIT", "the MIT", "2"]
    texts += [f"Licensed {p.upper()}! {p} and {q}" for p, _ in PHRASES for q, _ in PHRASES]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, texts[130], "x", 1), (1, texts[1], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, notices string, Places int")
    got = licences.digest(docs).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for doc_id, text, *_ in rows:
        assert tuple(by_id[doc_id])[1:8] == digest_by_hand(text)
    assert licences.digest(docs.limit(0)).count() == 0
    assert licences.with_notices(docs).columns == ["doc_id", "text", "n_words", "places", "notices"]


def test_own_notices(spark):
    docs = spark.createDataFrame([("No waranty is given",), (None,)], "body string")
    own = (Notice("warranty", "no warranty is given", 1),)
    rows = licences.with_notices(docs, own, (), "body").collect()
    assert [tuple(n)[:4] for n in rows[0]["notices"]] == [("warranty", 1, 0, 4)]
    assert rows[1]["notices"] == [] and rows[0]["places"] == []
