import collections
import hashlib
import zlib

from corpus_fixtures import docs  # noqa: F401
from relpredict.llm.manifest import manifest

LOWER = {c: c + 32 for c in range(65, 91)}
ROWS = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree int, size string, place int, leaf int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def hung(digests):
    """Root and path of each leaf, run by run."""
    paths = [[] for _ in digests]
    level = [(d, [i]) for i, d in enumerate(digests)]
    while len(level) > 1:
        above = []
        for start in range(0, len(level), 16):
            run = level[start : start + 16]
            for k, (_, leaves) in enumerate(run):
                for i in leaves:
                    paths[i].append(("".join(d for d, _ in run[:k]), "".join(d for d, _ in run[k + 1 :])))
            above.append((digest(*[d for d, _ in run]), [i for _, leaves in run for i in leaves]))
        level = above
    return level[0][0], paths


def brute(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    sources = collections.defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        leaf = tampered = digest(*map(field, (doc_id, source, lang, n_chars, text)))
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
            tampered = digest(*map(field, (doc_id, source, lang, n_chars, text and text.translate(LOWER))))
        sources[source].append((doc_id is not None, doc_id or 0, leaf, doc_id, tampered))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [(sorted(sources[s]), *hung([x[2] for x in sorted(sources[s])])) for s in names]
    root, tops = hung([t[1] for t in trees])
    out = []
    for (leaves, subroot, paths), top in zip(trees, tops, strict=True):
        for (_, _, leaf, doc_id, tampered), path in zip(leaves, paths, strict=True):
            folded = tampered
            for before, after in path + top:
                folded = digest(before, folded, after)
            out.append((doc_id, leaf, subroot, root, digest(*[b + a for b, a in path + top]), folded, folded == root))
    return out


def same(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], ROWS)
    found = [tuple(r) for r in manifest(frame).collect()]
    assert sorted(found, key=repr) == sorted(brute(rows), key=repr)
    return found


def test_ties_repeated_rows_nulls_and_odd_ids(spark):
    rows = [
        *[(None, None, "en", 3, "Ab")] * 2,
        (None, None, "en", 4, "Cd"),
        (5, "x", "en", 1, None),
        (5, "x", "en", 1, ""),
        *[(-7, "x", None, None, "É B")] * 2,
        (2**63 - 1, "x", None, None, "q"),
        (-(2**63), "x", None, None, "q"),
        (1, "", "en", 0, "LONG " * 50_000),
    ]
    rows += [(i * 37 - 500, "h" if i % 3 else "é", None, i, "T" * i) for i in range(700)]
    rows += [(9, "h", "a", 1, "Rep")] * 300 + [(9, "h", "a", i, "Rep") for i in range(300)]
    found = same(spark, rows)
    assert {r[-1] for r in found} == {True, False}


def test_sizes_around_a_run(spark):
    for n in (1, 16, 17, 257):
        same(spark, [(i, "a", "en", 1, f"Text {i}") for i in range(n)])
    same(spark, [(i, f"s{i}", "en", 1, f"Text {i}") for i in range(18)])  # a leaf a source


def test_empty_table(docs):
    assert manifest(docs("x").limit(0)).count() == 0
