from collections import Counter, defaultdict

from helixframe.plans import bridge


def test_every_document_is_in_the_patterns(spark, tmp_path):
    rows = [(1, "ACGT", "en", "s"), (2, "gatt", "en", "s"), (3, "A-C", "de", "s"), (4, "TTTTT", "fr", "s"), (5, "CC", "de", "s"), (6, "G", "es", None), (7, "", "es", "s"), (8, None, "en", "r"), (9, "CA", "en", "s"), (10, "GGG", "xx", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    _, axes, patterns = bridge.family_patterns(spark, str(tmp_path))
    families, nth = defaultdict(dict), Counter()
    for _, t, lang, source in rows:
        nth[source, lang] += 1
        families[source, nth[source, lang]][lang] = "".join(c for c in (t or "").upper() if c in "ACGT")
    want = Counter()
    for f in families.values():
        for k in range(max(len(f.get(a, "")) for a, _ in axes)):
            want[tuple("ACGT".index(f[a][k]) if k < len(f.get(a, "")) else -1 for a, _ in axes)] += 1
    got = {tuple(r["pattern"]): r["n"] for r in patterns.collect()}
    assert got == dict(want)
    assert sum(n * sum(x >= 0 for x in p) for p, n in got.items()) == sum(len(t.replace("-", "")) for _, t, lang, _ in rows if t and lang != "xx")
