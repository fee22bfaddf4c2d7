"""Glossaries of plain text (T5-T9, W2, W4, A9, A11, G1-G5) against a plain version that goes through each text line by line."""

import random
import re

from lucerna.functions.text import METADATA
from lucerna.operators import parse
from lucerna.plans.queries import QUERIES
from tests.conftest import SF

LINES = [
    "Alpha. The first letter of the alphabet, here.", "Alpha", "alpha: a short one", "Beta", "A long definition of beta that goes on and on.", "It goes on in a second line.", "12", "A", "Course glossary", "Gamma ray: some words after a colon",
    "Gamma ray", "GAMMA RAY. Light of very short waves that comes from nuclei.", "- Delta wave", "slow waves seen in deep sleep", "Scope", "", "", "The Omega", "x", "A Epsilon. The fifth letter of the same alphabet. It is small.", "Included scope: nothing at all of this", "Zeta",
]


def collapse(x):
    return re.sub(r"\s+", " ", x, flags=re.ASCII).strip()


def clean(x):
    return re.sub(r"^[A-Z]\s+(?=[A-Z][a-z])", "", re.sub(r"\s+", " ", re.sub(r"^[-*]\s+", "", x))).strip()


def is_term(x):
    x = collapse(x)
    short = x != "" and len(x) <= 96 and len(x.split()) <= 10
    return short and bool(re.search("[A-Za-z]", x)) and not re.match(r"(a|an|the)\s", x.lower()) and x[-1] not in ".!?" and not re.search(r"[.!?].+\s", x)


def is_definition(x):
    x = collapse(x)
    return len(x) >= 24 or len(x.split()) >= 4


def ignored(term, definition):
    t, d = clean(term).lower(), collapse(definition)
    return t == "" or d == "" or t in METADATA or "glossary" in t or t.startswith("included ") or d.isdigit()


def entry(line):
    m = re.search(parse._ENTRY, line)
    if m and is_term(clean(m[1])) and is_definition(m[2]) and not ignored(clean(m[1]), collapse(m[2])):
        return clean(m[1]), collapse(m[2])


def inline(text):
    flat = collapse(" ".join(x.strip() for x in text.split("\n") if x.strip() and not x.strip().isdigit()))
    start = re.search(parse._FIRST, flat, re.ASCII)
    flat = flat[start.start() :].strip() if start else flat
    found = [(clean(m[1]), collapse(m[2])) for m in re.finditer(parse._INLINE, flat, re.ASCII)]
    return [(n, t, d) for n, (t, d) in enumerate(found) if is_term(t) and is_definition(d) and not ignored(t, d)]


def sectioned(text):
    out = []
    for n, line in enumerate(filter(None, map(collapse, text.split("\n")))):
        if re.search(parse._NOT_ENTRY, line) or re.fullmatch("[A-Z]", line):
            continue
        if entry(line):
            out.append([n, entry(line)[0], [entry(line)[1]]])
        elif out:
            out[-1][2].append(line)
    return [(n, t, collapse(" ".join(d))) for n, t, d in out]


def pairs(lines, starts):
    out, n = [], 0
    while n < len(lines):
        after = lines[n + 1] if n + 1 < len(lines) else ""
        if n + 1 < len(lines) and is_term(lines[n]) and is_definition(after) and not ignored(lines[n], after):
            out.append((n, clean(lines[n]), after))
            n += 1
        elif starts and entry(lines[n]):
            out.append((n, *entry(lines[n])))
        n += 1
    return out


def one_each(entries, name, keep=lambda t, d: True):
    groups = {}
    for n, t, d in entries:
        if keep(t, d):
            groups.setdefault(name(t), []).append((n, t, d))
    return groups


def longest(group):
    return max(group, key=lambda e: (len(e[2]), -e[0]))


def glossary(text):
    lines = list(filter(None, map(collapse, text.split("\n"))))
    paragraphs = list(filter(None, map(collapse, re.split(r"\n\s*\n+", text))))
    ways = [inline(text), sectioned(text), pairs(paragraphs, False), pairs(lines, True)]
    tidy = [[(min(e[0] for e in g), *longest(g)[1:]) for g in one_each(w, lambda t: clean(t).lower(), lambda t, d: not ignored(t, d)).values()] for w in ways]
    some = [(k, w) for k, w in enumerate(tidy) if w]
    enough = [w for _, w in some if len(w) >= 3]
    mean = lambda w: sum(len(d) for _, _, d in w) / len(w)
    chosen = enough[0] if enough else max(some, key=lambda kw: (len(kw[1]), mean(kw[1]), -kw[0]))[1] if some else []
    colons = []
    for n, line in enumerate(x.strip() for x in text.split("\n") if x.strip()):
        t, sep, d = line.partition(":")
        if sep and not ignored(clean(t), d.strip()):
            colons.append((n, clean(t), d.strip()))
    told = chosen if len(chosen) > 1 else colons or chosen

    def keeps(t, _):
        t = t.strip().lower()
        return len(t.split()) <= 7 and t != "" and not re.fullmatch("[a-z]", t) and not re.search("[.!?]", t) and "glossary" not in t and t not in METADATA

    out = []
    for name, g in one_each(told, lambda t: t.strip().lower(), keeps).items():
        first = min(g)
        spellings = dict.fromkeys(t for _, t, _ in sorted(g) if t != first[1])
        out.append((first[0], name, first[1], longest(g)[2], list(spellings)))
    return [(i, t, d, a) for i, (_, _, t, d, a) in enumerate(sorted(out))]


def test_glossaries_of_many_texts(spark):
    random.seed(7)
    texts = ["\n".join(random.choices(LINES, k=random.randrange(1, 14))) for _ in range(150)] + ["", "\n \n", "Alpha. The first letter of the alphabet, here."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc int, text string").repartition(4)
    got = {}
    for r in parse.glossary(df, ["doc"]).collect():
        got.setdefault(r.doc, []).append((r.order_index, r.term, r.definition, list(r.aliases)))
    want = {k: g for k, x in enumerate(texts) if (g := glossary(x))}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert len(want) > 100


def test_query(spark):
    texts = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect():
        texts.setdefault(r.item_id // 10, []).append(f"{' '.join(r.text.split(' ')[:2])}: {r.text}")
    want = sorted((doc, i, t, d, ",".join(a)) for doc, x in texts.items() for i, t, d, a in glossary("\n".join(x)))
    got = sorted((r.doc, r.order_index, r.term, r.definition, r.aliases) for r in QUERIES["T5_T9_glossary"](spark, SF).collect())
    assert got == want and got
