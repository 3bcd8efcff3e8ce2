"""Plain versions of the corpus operators, and awkward documents."""

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
LOW = {i: chr(i + 32) for i in range(65, 91)}

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate(LOW)


LONG_LINE = "This very common line is longer than forty code points, as it should be"
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


def awkward():
    """Rows with nulls, empty texts, repeats, ties, copies and odd white space."""
    rows = [
        (0, None, "en", "a"), (1, "", None, "a"), (2, " \n\t ", "en", None), (3, "x", "en", "a"), (4, "a b c", "en", "b"), (5, "A B C", "en", "b"),
        (6, "é ü ö 　 中文 \x1c x", "fr", "b"), (7, "\n\n\n", "de", "c"), (None, LONG_LINE, "en", "c"), (None, None, None, None),
        (8, PASSAGE + " tail of eight", "en", "a"), (9, "head " + PASSAGE, "en", "a"), (10, PASSAGE + "\n" + PASSAGE, "en", "a"),
    ]
    rows += [(20 + i, f"start {i}\n  {LONG_LINE.upper() if i % 2 else LONG_LINE}\t\nend {i}\n{LONG_LINE}", "en", "a") for i in range(7)]
    base = [f"w{i}" for i in range(80)]
    for i in range(6):
        mine = list(base)
        mine[i * 9] = f"new{i}"
        rows.append((40 + i, " ".join(mine), "en", "d"))
    rows += [(50, " ".join(base), "en", "d"), (50, " ".join(base), "en", "d"), (51, "word " * 400, "en", "d")]
    return [(*r, len(r[1] or "")) for r in rows]


def frame(spark, rows=None):
    rows = awkward() if rows is None else rows
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def by_id(df, *columns):
    """Sorted rows, nulls first."""
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda t: [(x is not None, str(type(x)), x) for x in t])


def union_find(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, k=4):
    w = words(lower(text))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def dedup_lines(rows, least=40, docs=5):
    holders = collections.defaultdict(set)
    key = lambda l: l.strip(SPACE).translate(LOW)
    order = lambda d: (d is not None, d or 0)
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(d)
    gone = {k: max(v, key=order) for k, v in holders.items() if len(v) >= docs}
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (key(x) in gone and gone[key(x)] != d)]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def dedup_windows(rows, k=13):
    order = lambda d: (d is not None, d or 0)
    first = {}
    for d, t, *_ in sorted(rows, key=lambda r: order(r[0])):
        w = words(t)
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i : i + k]), d)
    out = []
    for d, t, *_ in rows:
        w, gone = words(t), set()
        for i in range(len(w) - k + 1):
            if order(first[tuple(w[i : i + k])]) < order(d):
                gone.update(range(i, i + k))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out
