"""Each operator on edge cases, and against brute force on small tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import parity
from tillframe.llm import bpe, common, decontamination, embedding_join, language, language_model, ngram_join, pii, queries, suffix_dedup, token_counts, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = {k: k + 32 for k in range(65, 91)}


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def made(seed, n=60, vocabulary=400):
    """Texts with copies, near copies, repeats, empties and nulls."""
    r = random.Random(seed)
    w = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 7))) for _ in range(vocabulary)]
    out = []
    for k in range(n):
        kind = r.random()
        if out and kind < 0.2 and (base := r.choice(out)):
            out.append(base)
        elif out and kind < 0.45 and (base := r.choice(out)):
            parts = base.split(" ")
            for _ in range(r.randint(1, 3)):
                parts[r.randrange(len(parts))] = r.choice(w)
            out.append(" ".join(parts))
        elif kind < 0.5:
            out.append(r.choice([None, "", " \n ", "One", "two  Words", "x " * 300]))
        else:
            out.append(" ".join(r.choice(w) for _ in range(r.randint(1, 220))))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(made(1))], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------- components


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(90), r.randrange(90)) for _ in range(60)] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 230)] + [(None, 1), (5, 5)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {x.node: x.component_id for x in common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {k: find(k) for k in got} and set(got) == {k for e in edges if None not in e and e[0] != e[1] for k in e}


# ---------------------------------------------------------------- 1


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, label_ string, points int")


def test_embedding_join_edges_and_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "CELL", 20)
    monkeypatch.setattr(embedding_join, "TILE", 16)
    r = np.random.default_rng(0)
    centres = r.normal(size=(6, 8))
    rows = [(k, [float(np.float32(x)) for x in centres[k % 6] + r.normal(0, 0.06 + 0.1 * (k % 3 == 0), 8)], k % 2, None, 0) for k in range(150)]
    rows += [(150 + k, rows[3][1], 1, "x", 1) for k in range(5)] + [(155, rows[3][1], 1, "x", 1)] * 2  # copies, and a repeated row
    odd = [(200, None, 1), (201, [0.0] * 8, 1), (202, [float("nan")] * 8, 1), (203, [None] * 8, 1), (204, rows[3][1], None), (205, [], 1), (206, rows[3][1][:7], 1), (207, [float("inf")] + [1.0] * 7, 1)]
    rows += [(*x, None, 0) for x in odd] + [(None, rows[3][1], 1, None, 0)]
    got = embedding_join.join(vectors(spark, rows)).collect()
    fine = [x for x in rows if x[0] is not None]
    assert len(got) == len(fine)
    live = [x for x in fine if x[0] < 200]
    v = np.array([x[1] for x in live])
    v /= np.linalg.norm(v, axis=1)[:, None]
    hit = (v @ v.T >= 0.98) & (np.array([x[2] for x in live])[:, None] == np.array([x[2] for x in live]))
    np.fill_diagonal(hit, False)
    least = [x[0] for x in live]
    for _ in range(len(live)):
        least = [min([least[k], *(least[j] for j in np.flatnonzero(hit[k]))]) for k in range(len(live))]
    want = Counter((x[0], int(hit[k].sum()), least[k], x[0] == least[k]) for k, x in enumerate(live))
    want.update((k, 0, k, True) for k in range(200, 208))
    assert Counter(map(tuple, got)) == want


def test_rows_of_one_key_are_vectors_of_their_own(spark):
    """Of two vectors of key 1, one has a neighbour and the other none; keys 3 and 4 have two each, in two components."""
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, a, 1), (1, b, 1), (2, [1.0, 0.01, 0.0], 1), (3, c, 1), (4, [0.0, 0.01, 1.0], 1), (3, [0.0, -1.0, 0.0], 1), (4, [0.01, -1.0, 0.0], 1), (3, c, 2), (4, b, 2)]
    got = Counter(map(tuple, embedding_join.join(vectors(spark, [(*x, None, 0) for x in rows])).collect()))
    assert got == Counter([(1, 1, 1, True), (1, 0, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (3, 1, 3, True), (4, 1, 3, False), (3, 0, 3, True), (4, 0, 4, True)])


def test_embedding_join_writes_less_than_its_vectors(spark):
    n, r = 4000, np.random.default_rng(2)
    v = r.normal(size=(n, 64)).astype(np.float32)
    v[1::100] = v[0::100] + np.float32(0.01) * r.normal(size=(n // 100, 64)).astype(np.float32)
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    held = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    before = held()
    df = spark.createDataFrame([(k, x.tolist(), 1) for k, x in enumerate(v)], "vec_id long, embedding array<float>, label int").repartition(3)
    assert sorted((x.vec_id, x.component_id) for x in embedding_join.join(df).where("n_links > 0").collect()) == [(k + j, k) for k in range(0, n, 100) for j in (0, 1)]
    assert held() - before < v.nbytes


@pytest.mark.parametrize("size", [1, 2, 7, 24, 25, 64, 300])
def test_codes_of_similar_vectors_are_within_reach(size):
    r = np.random.default_rng(size)
    v, w = (embedding_join.units(r.normal(size=(3000, size))) for _ in "vw")
    w = embedding_join.units(v + r.uniform(0, 0.21, (3000, 1)) * w)
    similar = (v * w).sum(1) >= 0.98
    x, y = (np.rint(embedding_join.STEPS * (z @ embedding_join.directions(size))) for z in (v, w))
    assert similar.sum() > 500 and (np.sqrt(((x - y) ** 2).sum(1))[similar] <= embedding_join.reach_of(0.98, x.shape[1])).all()


def test_embedding_join_of_nothing(spark):
    assert embedding_join.join(vectors(spark, [])).count() == 0


# ---------------------------------------------------------------- 2

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def good(kind, m):
        d = [int(c) for c in m if c in "0123456789"]
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(reversed(d))) % 10 == 0
        return all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else 9 <= len(d) <= 15 if kind == "phone" else True

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if good(k, m.group())]


def test_patterns_equal_plain_search():
    r = random.Random(3)
    for _ in range(4000):
        t = "".join(r.choice(["a", ".", "@", "1", "29", " ", "-", "+", "(", ")", "é", "4111111111111111", "255", ".1.2.3", "%_", "x.y"]) for _ in range(r.randrange(25)))
        assert pii.pattern_spans(t) == plain_spans(t), t
    for t in ("9" * 30_000, "a" * 50_000, "1." * 20_000, "+1" + " " * 30_000, "@" * 5_000):
        pii.pattern_spans(t)


def test_tagger_on_unseen_windows():
    tagger = pii.trained()
    x, y = pii.labelled_windows(random.Random(123), 200, pii.labelled_texts(random.Random(5), 200))
    assert (tagger.decode(tagger.scores(x)[0]) == y).mean() > 0.96


def test_screen_passes_over_no_labelled_span():
    spans = lost = 0
    for text, tags in pii.labelled_texts(random.Random(31), 1500):
        cuts = np.flatnonzero(np.diff([0, *tags, 0]))
        for s, e in zip(cuts.tolist(), cuts[1:].tolist()):  # noqa: B905
            if tags[s]:
                spans += 1
                lost += not any(b <= s and e <= t for b, t in pii.screened(text))
    assert spans > 3000 and lost <= 0.002 * spans


def test_tagger_adds_what_patterns_miss(spark):
    """On documents: secrets, which have no pattern. On a line: forms without a pattern."""
    docs = common.read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in queries.QUERIES["op2_pii"](spark, "/root/testdata/sf0.01").collect()}
    planted = found = 0
    for r in docs:
        spans = [tuple(x.split(":")) for x in rows[r.doc_id].spans.split(",") if x]
        base = plain_spans(r.text or "")
        assert rows[r.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [sum(k == x for k, _, _ in base) for x in PATTERNS] == [rows[r.doc_id][f"n_{x}"] for x in PATTERNS]
        assert {(k, str(a), str(b)) for k, a, b in base} <= set(spans) and rows[r.doc_id].n_spans == len(spans)
        for m in re.finditer(r'token = "([0-9a-f]{40})"|password=([0-9a-f]{18})|\b(AKIA[A-Z0-9]{16})\b', r.text or ""):
            planted += 1
            found += any(k == "secret" and int(a) <= m.start(m.lastindex) and int(b) >= m.end(m.lastindex) for k, a, b in spans)
    added = sum(x.startswith("secret:") for r in rows.values() for x in r.spans.split(","))
    assert planted >= 10 and found >= 0.9 * planted and added <= 1.1 * planted, (planted, found, added)
    tagger = pii.trained()
    for line, kind in (("call 555-123-4567 now", "phone"), ("write to joe.smith (@) mail.example.org today", "email")):
        assert [x[0] for x in pii.reconcile([], pii.tagged_spans(tagger, [line])[0])] == [kind]


def test_secrets_are_marked_whole_or_not_at_all():
    """Forms that the tagger hasn't been taught: what it marks of a token, it marks all of."""
    r = random.Random(77)
    some = lambda alphabet, k: "".join(r.choices(alphabet, k=k))
    both = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    forms = {
        "ghp": lambda: ("ghp_" + some(both, 36), "the key is {} ok"),
        "aws": lambda: (some(both, 40), "AWS_SECRET_ACCESS_KEY={}\n"),
        "bearer": lambda: (".".join(some(both + "_-", k) for k in (20, 40, 30)), "Authorization: Bearer {}\nnext"),
        "live": lambda: ("sk_live_" + some(both, 24), "set {} in the file"),
        "padded": lambda: (some(both, 43) + "=", "secret: {}."),
    }
    tagger, found = pii.trained(), Counter()
    for name, form in forms.items():
        for _ in range(20):
            secret, around = form()
            text = "some words before it and then " + around.format(secret) + " and words after that"
            a, b = text.index(secret), text.index(secret) + len(secret)
            marked = [(s, e) for _, _, s, e in pii.tagged_spans(tagger, [text])[0] if s < b and e > a]
            assert all(s <= a and e >= b for s, e in marked), (name, text, marked)
            found[name] += bool(marked)
    assert sum(found.values()) >= 70, found
    assert pii.whole_secrets("x ab.cd-ef. y", [(1.0, "secret", 3, 4), (2.0, "secret", 6, 8), (1.0, "ip", 0, 1)]) == [(1.0, "ip", 0, 1), (2.0, "secret", 2, 10)]
    long = "a1" * 200_000
    assert pii.whole_secrets(long, [(1.0, "secret", k, k + 20) for k in range(0, 300_000, 40)]) == [(1.0, "secret", 0, 400_000)]


def test_tagger_gradients():
    """The analytic gradients equal finite differences of the CRF's loss."""
    tagger = pii.Tagger(1)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    x, y = pii.labelled_windows(random.Random(5), 3, pii.labelled_texts(random.Random(6), 9))
    x, y = x[:9], y[:9]

    def loss():
        u, _ = tagger.scores(x)
        a, total = tagger.p["next"], u[0]
        for t in range(1, len(u)):
            total = np.log(np.exp(total[:, :, None] + a).sum(1)) + u[t]
        path = sum(u[t, np.arange(3), y[t]] for t in range(len(u))) + sum(a[y[t - 1], y[t]] for t in range(1, len(u)))
        return float((np.log(np.exp(total).sum(1)) - path).mean())

    g = tagger.gradients(x, y)
    for name in ("next", "out", "fh", "bx", "embed"):
        flat = tagger.p[name].ravel()
        k = int(np.argmax(np.abs(g[name].ravel())))
        flat[k] += 1e-5
        up = loss()
        flat[k] -= 2e-5
        down = loss()
        flat[k] += 1e-5
        assert abs((up - down) / 2e-5 - g[name].ravel()[k]) < 1e-3 * max(1, abs(g[name].ravel()[k])), name


def test_reconcile_keeps_base_and_best():
    base = [("ip", 10, 20)]
    found = [(5.0, "phone", 0, 8), (9.0, "phone", 4, 10), (6.0, "card", 8, 10), (50.0, "card", 15, 30)]
    assert pii.reconcile(base, found) == [("ip", 10, 20), ("card", 8, 10), ("phone", 0, 8)]


def test_tagger_reads_long_forms_whole():
    """Wherever windows begin, and however far a form goes on beside its @."""
    tagger = pii.trained()
    for form in ("firstname.longer.lastname [@] mailserver.long-company.com", "maria_fernandalonggonzalez [@] mail3.administrationministerio.com"):
        for k in range(0, 90, 7):
            for text in ("word " * 30 + form + " and more words", "w 12 " * 20 + "a" * k + " " + form + " w 12" * 20):
                marked = [text[s:e] for _, kind, s, e in pii.tagged_spans(tagger, [text])[0] if kind == "email"]
                assert marked == [form], (k, marked)
    pii.tagged_spans(tagger, ["9" * 30_000, "a" * 30_000 + "@" + "b" * 3000])


def test_pii_on_edge_cases(spark, empty):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "é mail a.b@c.de now", "en", "s", 0), (3, "é mail a.b@c.de now", "en", "s", 0), (4, "w " * 40_000 + "1.2.3.4", "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit(1))
    got = {r.doc_id: [(x["kind"], x["start"], x["end"]) for x in r.base] for r in pii.find(df).collect()}
    assert got == {1: [], 2: [], 3: [("email", 7, 15)], 4: [("ip", 80_000, 80_007)]}
    df = df.withColumn("base", F.lit("b"))
    assert {r.doc_id: (r.text, r.spans, r.base) for r in pii.masked(df.where("doc_id < 4")).collect()} == {1: (None, 1, "b"), 2: ("", 1, "b"), 3: ("é mail [email] now", 1, "b")}
    assert pii.find(empty).count() == 0


# ---------------------------------------------------------------- 3


def test_language(spark, empty):
    docs = common.read(spark, SF, "documents")
    model = language.train(docs)
    found = language.identify(docs.select("doc_id", "text", F.col("lang").alias("truth")), model).collect()
    assert sum(r.truth == r.lang for r in found) >= 0.97 * len(found) and len(found) == docs.count()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34"), (3, "12 34")], "doc_id long, text string").withColumn("lang", F.lit("zz"))
    assert all(r.rejected and r.lang_by_text is None for r in language.identify(odd, model, host=F.lit("h")).collect())
    assert language.identify(empty.select("doc_id", "text"), model).count() == 0


def test_evidence_outweighs_a_short_text(spark):
    model = language.train(common.read(spark, SF, "documents"))
    texts = [r.text for r in common.read(spark, SF, "documents").where("lang = 'fr'").limit(20).collect()]
    rows = [(k, t, "h.fr", "fr") for k, t in enumerate(texts)] + [(99, "le", "h.fr", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, said string")
    r = language.identify(df, model, host=F.col("host"), suffix=F.lit("fr"), declared=F.col("said")).where("doc_id = 99").first()
    assert r.lang == "fr" and r.confidence > 0.9


def test_language_fusion_equals_plain_bayes(spark):
    """The posterior of every row from its likelihoods and the other rows' counts."""
    docs = common.read(spark, SF, "documents").select("doc_id", "text", "source", "lang")
    model = language.train(docs)
    r = random.Random(12)
    texts = [x.text for x in docs.orderBy("doc_id").collect()]
    rows = [(k, (t[: r.randint(0, 30)] if k % 3 else t), r.choice(["a.de", "b.de", "c.fr", None]), r.choice(["de", "fr", None]), r.choice(["de", "xx", None])) for k, t in enumerate(texts)] + [(900, None, "a.de", "de", "de"), (901, "", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, suffix string, said string")
    seen = {x.doc_id: x for x in language.text_evidence(df, model, "text").collect()}
    names = model.languages
    vote = {k: int(np.argmax(x.ll)) if x.letters else None for k, x in seen.items()}
    total = np.array([sum(v == n for v in vote.values()) + 1.0 for n in range(len(names))])
    for keep in (False, True):
        got = {x.doc_id: x for x in language.identify(df, model, host=F.col("host"), suffix=F.col("suffix"), declared=F.col("said"), keep_text=keep).collect()}
        assert len(got) == len(rows) and all(("text" in x.asDict()) == keep for x in got.values())
        for k, _, *stated in rows:
            own = np.array([float(vote[k] == n) for n in range(len(names))])
            count = lambda c, v, own=own: np.array([sum(x[c] == v and vote[x[0]] == n for x in rows) for n in range(len(names))], float) - own
            p = total / total.sum()
            for c in (3, 2):
                n = count(c, stated[c - 2]) if stated[c - 2] else np.zeros(len(names))
                p = (n + language.LEAN * p) / (n.sum() + language.LEAN)
            score = np.array(seen[k].ll) + np.log(p)
            if stated[2]:
                score += np.log((count(4, stated[2]) + 1) / (total - own + 1))
            posterior = np.exp(score - score.max())
            posterior /= posterior.sum()
            assert got[k].lang == names[int(np.argmax(score))] and math.isclose(got[k].confidence, posterior.max(), rel_tol=1e-9)
            assert got[k].rejected == (seen[k].letters == 0 or posterior.max() < language.MIN_CONFIDENCE)


def test_declared_language_stands_anywhere(spark, tmp_path):
    """Behind a long comment, script or blank run; not inside one."""
    fronts = ["", "<!-- <html lang=xx> " + "c" * 5000 + " -->", "<script>" + "x = '<html lang=xx>';" * 200 + "</script>", " \n" * 3000, "<!--[if IE]><html lang='xx'><![endif]-->"]
    pages = [(k, "https://a.b/", f"{front}<HTML class=a lang='fr-FR'><body>la maison</body></html>") for k, front in enumerate(fronts)] + [(8, "https://a.b/", "<html><p lang=fr>"), (9, "https://a.b/", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, "la maison", "fr", "s", 9)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    known, language.identify = language.identify, lambda df, *a, **k: seen.append(df.where("kind = 'page'").collect()) or known(df, *a, **k)
    try:
        assert language.op3_language_id(spark, str(tmp_path)).count() == len(pages) + 1
    finally:
        language.identify = known
    assert {r.page_id: r.declared and r.declared.lower() for r in seen[0]} == {k: "fr" for k in range(len(fronts))} | {8: None, 9: None}


def test_language_keeps_clashing_columns(spark):
    """Columns named like the operator's own come back as they went in; those of its outputs are replaced."""
    model = language.train(common.read(spark, SF, "documents"))
    names = ["stated", "n_host", "host_", "by_text", "score_", "top_", "ll", "row", "_", "host"]
    rows = spark.createDataFrame([(1, "la maison est belle", *range(len(names)), "mine")], "doc_id long, text string" + "".join(f", `{c}` int" for c in names) + ", confidence string")
    for keep in (False, True):
        out = language.identify(rows, model, host=F.lit("h.fr"), suffix=F.lit("fr"), keep_text=keep)
        assert out.columns == ["doc_id", *["text"] * keep, *names, "lang", "confidence", "letters", "lang_by_text", "rejected"]
        r = out.first()
        assert [r[c] for c in names] == list(range(len(names))) and r.confidence > 0.5


def test_address(spark):
    df = spark.createDataFrame([("https://m.a.example.com:80/x",), ("nonsense",), (None,)], "url string")
    host, domain, suffix = language.address(F.col("url"))
    assert [tuple(r) for r in df.select(host.alias("h"), domain.alias("d"), suffix.alias("s")).collect()] == [("m.a.example.com", "example.com", "com"), (None, None, None), (None, None, None)]


# ---------------------------------------------------------------- 4


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    parity.same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], parity.connect(SF))


def test_decontamination_of_short_items(spark, docs, empty):
    bench = spark.createDataFrame([(1, "the QUICK brown"), (2, "a b c d e f g h i j k l"), (3, None), (4, "!!"), (5, "quick")], "item_id long, text string")
    texts = spark.createDataFrame([(1, "see the quick, brown fox"), (2, "x a b c d e f g h i j y"), (3, None), (4, ""), (4, "quick quick")], "doc_id long, text string").withColumn("items", F.lit(1)).withColumn("hits", F.lit("x")).withColumn("key", F.lit(2)).withColumn("own", F.lit(3)).withColumn("a.b", F.lit(4)).withColumn("hash", F.lit(5))
    rows = decontamination.scan(texts, decontamination.benchmark_windows(bench)).select("doc_id", "n_words", F.sort_array(decontamination.covered(F.col("hits"))).alias("c"), "items").collect()
    got = sorted((r.doc_id, r.n_words, r.c, r["items"]) for r in rows)
    assert got == [(1, 5, [2, 3, 4], ["1", "5"]), (2, 12, list(range(2, 12)), ["2"]), (3, 0, [], []), (4, 0, [], []), (4, 2, [1, 2], ["5"])]
    scanned = decontamination.scan(texts, decontamination.benchmark_windows(bench))
    assert sorted(scanned.columns) == sorted({*texts.columns, "n_words"} - {"text"})
    windows = decontamination.benchmark_windows(bench)
    cut = {r.doc_id: r.text for r in decontamination.remove_spans(texts.where("doc_id < 3"), windows).collect()}
    assert cut == {1: "see  ,  fox", 2: "x           y"}
    again = texts.union(texts).withColumn("_key", F.lit(8)).withColumn("_cut", F.lit("c")).withColumn("row", F.lit(1)).withColumn("left", F.lit("l"))
    kept = decontamination.remove_spans(again, windows)
    assert kept.columns == again.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, "see  ,  fox"), (2, "x           y"), (3, None), (4, ""), (4, " ")] * 2)
    assert {(r._key, r._cut, r.row, r.left, r["items"], r.hits, r["a.b"]) for r in kept.collect()} == {(8, "c", 1, "l", 1, "x", 4)}
    assert decontamination.scan(empty, decontamination.benchmark_windows(bench)).count() == 0
    assert decontamination.scan(docs, decontamination.benchmark_windows(bench.where("false"))).where(F.size("hits") > 0).count() == 0


@pytest.mark.parametrize("broadcast", [64 << 20, 0])
def test_decontamination_equals_plain_search(spark, monkeypatch, broadcast):
    """Items of one to fourteen words in texts around the length of a segment, few different words, hits side by side and over each other."""
    monkeypatch.setattr(decontamination, "SEGMENT", 16)
    monkeypatch.setattr(decontamination, "MAX_BROADCAST_BYTES", broadcast)
    r = random.Random(21)
    items = [(k, " ".join(r.choice("abc") for _ in range(1 + k % 14 if k > 6 else 5 + k))) for k in range(40)]
    texts = [(k, " ".join(r.choice("abcd") for _ in range(r.randrange(0, 70)))) for k in range(120)]
    windows = {}
    for k, t in items:
        w = t.split()
        for i in range(max(1, len(w) - 9)):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(k))
    want = {}
    for k, t in texts:
        w = t.split()
        hits = {(i + 1, m) for m in {len(x) for x in windows} for i in range(len(w) - m + 1) if tuple(w[i : i + m]) in windows}
        want[k] = (len(w), hits, sorted({x for i, m in hits for x in windows[tuple(w[i - 1 : i - 1 + m])]}))
    df, bench = (spark.createDataFrame(x, f"{n} long, text string") for x, n in ((texts, "doc_id"), (items, "item_id")))
    got = decontamination.scan(df, decontamination.benchmark_windows(bench)).collect()
    assert {x.doc_id: (x.n_words, {tuple(h) for h in x.hits}, x["items"]) for x in got} == want and all(len(x.hits) == len(set(x.hits)) for x in got)


def test_decontamination_of_long_texts(spark, monkeypatch):
    """Hits lie in any segment, or across two; time goes with the words."""
    bench = spark.createDataFrame([(1, " ".join(f"b{k}" for k in range(12))), (None, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10")], "item_id long, text string")
    windows = decontamination.benchmark_windows(bench)
    n = 640_000
    text = [f"w{k % 977}" for k in range(n)]
    at = (0, decontamination.SEGMENT - 5, 5 * decontamination.SEGMENT, n - 12)
    for a in at:
        text[a : a + 12] = [f"b{k}" for k in range(12)]
    texts = spark.createDataFrame([(1, " ".join(text)), (2, "x q1 q2 q3 q4 q5 q6 q7 q8 q9 q10")], "doc_id long, text string")
    for most in (decontamination.MAX_BROADCAST_BYTES, 0):
        monkeypatch.setattr(decontamination, "MAX_BROADCAST_BYTES", most)
        began = time.monotonic()
        got = {r.doc_id: (r.n_words, sorted(h.start for h in r.hits), r["items"]) for r in decontamination.scan(texts, windows).collect()}
        assert got == {1: (n, sorted(a + k for a in at for k in (1, 2, 3)), ["1"]), 2: (11, [2], [])}
        assert time.monotonic() - began < 60


# ---------------------------------------------------------------- 5


def plain_repeats(texts):
    raws = [(t or "").encode() for t in texts]
    n = Counter(b[k : k + 400] for b in raws for k in range(len(b) - 399))
    out = []
    for b in raws:
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if n[b[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


def repeated_texts(seed):
    r = random.Random(seed)
    w = ["".join(r.choice("abcdé") for _ in range(r.randint(2, 6))) for _ in range(200)]
    line = lambda n: " ".join(r.choice(w) for _ in range(n))
    passage, other = line(110), line(90)
    texts = [line(r.randint(5, 150)) + " " + passage + " " + line(r.randint(0, 60)) for _ in range(14)]
    texts += [line(40) + passage[: r.randint(390, 420)] + line(30) for _ in range(8)]
    texts += [texts[0], texts[0], "Orre " * 300, "ab" * 900, "-" * 1000, "-" * 399, "-" * 400, None, "", "short", other * 3, line(100) + other + passage]
    return texts


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 3])
def test_suffix_dedup_equals_brute_force(spark, empty, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    texts = repeated_texts(2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("k", F.lit(0)).repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == dict(enumerate(plain_repeats(texts)))
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_of_repeated_rows(spark):
    t = "word " * 100 + "end"
    rows = suffix_dedup.remove_repeats(spark.createDataFrame([(1, t), (1, t), (None, "x")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (1, 503), (1, 503)]


def test_deep_shallow_order():
    r = random.Random(6)
    for _ in range(200):
        base = bytes(r.choice(b"ab") for _ in range(60))
        s = [base[: r.randint(0, 60)] + bytes(r.choice(b"abc") for _ in range(r.randint(0, 5))) for _ in range(r.randint(1, 30))]
        assert [s[k] for k in suffix_dedup.deep_shallow_order(s)] == sorted(s)


# ---------------------------------------------------------------- 6


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    ranks, pattern = bpe.vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


ODD = [None, "", " ", "  ", "a  b", "\n \n x", "x  　 y ", "日本語 漢字 😀é", "---" * 500, " " * 900 + "x", "I'll don't 12345 ½ x² ", "<|endoftext|> hi", "A" * 5000, "​ \n\n q", "of the in"]


def test_bpe_equals_the_library(spark, docs, empty, tik, monkeypatch):
    for bound, n in (("MAX_STATES", 300), ("MAX_PAIRS", 50), ("MAX_PIECES", 40), ("LONG_WORD", 20), ("TOGETHER", 256)):
        monkeypatch.setattr(bpe, bound, n)
    common.kept.clear()
    ranks, pattern = bpe.vocabulary()
    df = docs.unionByName(spark.createDataFrame([(1000 + k, t, "x", "y", 0) for k, t in enumerate(ODD)], DOCS)).withColumn("decoded", F.lit(1))
    rows = bpe.round_trip(df.select("doc_id", "decoded", "text", F.col("text").alias("was")), ranks, pattern).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert r.ids == tik.encode_ordinary(r.was or "") and bytes(r.decoded).decode() == (r.was or "") and r.well_formed
    two = bpe.decode(bpe.encode(df.select("doc_id", "text"), ranks, pattern), ranks, feed=1)
    assert all(r.decoded == (r.text or "") for r in two.collect())
    assert bpe.round_trip(empty, ranks, pattern).count() == 0


ILL_FORMED = ["aé😀日".encode() * 3, b"\xff\xc3", b"\xe2\x82", b"ok\xf0\x9f\x98", b"\xc3\xa9\xa9", b"\xed\xa0\x80x", b"\xf4\x90\x80\x80", b"\xe0\x80\xaf\xc0\xaf", b"\xf0\x9f\xc3\xa9"]


def test_utf8_machine():
    r = random.Random(2)
    for raw in [*ILL_FORMED, *(bytes(r.choice(b"a\xc3\xa9\xe2\x82\xac\xf0\x9f\x98\x80\xed\xff") for _ in range(r.randint(1, 9))) for _ in range(500))]:
        for step in (1, 2, 3, 5):
            m = bpe.Utf8()
            text = b"".join(m.feed(raw[k : k + step]) for k in range(0, len(raw), step)) + m.close()
            assert text.decode() == raw.decode("utf-8", "replace")


def test_decoder_streams_whole_characters(tik):
    decoder = bpe.Decoder(bpe.vocabulary()[0])
    for raw in [*ILL_FORMED, "naïve 日本語 漢字 😀é 🤷🏽‍♀️ ".encode() * 5]:
        ids = np.array([tik.encode_single_token(bytes([c])) for c in raw] + tik.encode("ok 漢字 😀"))
        for feed in (1, 2, 7, 4096):
            parts = list(decoder.stream(ids[k : k + feed] for k in range(0, len(ids), feed)))
            assert "".join(parts) == decoder.decode(ids).decode("utf-8", "replace")


def test_transducer_equals_merging(tik):
    t = bpe.Transducer(bpe.vocabulary()[0])
    r = random.Random(8)
    words = ["".join(r.choice(" theandoingtion's") for _ in range(r.randint(1, 700 if r.random() < 0.02 else 14))).encode() for _ in range(2000)]
    want = [tik._encode_single_piece(w) for w in words]
    assert [t.encode(w) for w in words[:400]] == want[:400]
    ends = np.cumsum([len(w) for w in words])
    tokens, counts = t.encode_many(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    assert tokens.tolist() == [x for w in want for x in w] and counts.tolist() == [len(w) for w in want]


def test_tokens_leave_after_a_bounded_lookahead(tik):
    """Long words don't wait for their end: what is held back stays within a few tokens' length."""
    ranks = bpe.vocabulary()[0]
    t, words, r = bpe.Transducer(ranks), {v: k for k, v in ranks.items()}, random.Random(9)
    for word in ["".join(r.choice("aeionrtlsdc") for _ in range(1500)), "abc" * 500, "a" * 900]:
        read = [0]

        def bytes_of(word=word, read=read):
            for c in word.encode():
                read[0] += 1
                yield c

        left, most = 0, 0
        for token in t.stream(bytes_of()):
            most = max(most, read[0] - left)
            left += len(words[token])
        assert left == len(word) and most <= 2 * max(map(len, ranks)), most


# ---------------------------------------------------------------- 7


def test_toxicity_on_held_out_labels(spark, empty):
    docs, labels = common.read(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text"), common.read(spark, "/root/testdata/sf0.1", "labels")
    seen = labels.where("doc_id % 3 <> 0")
    chain = toxicity.train(docs, seen, toxicity.CATEGORIES)
    held = toxicity.score(docs, chain).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert sum((r.p_toxic >= 0.5) == (r.toxic == 1) for r in held) >= 0.97 * len(held)
    odd = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, "word " * 50_000)], "doc_id long, text string").withColumn("p_toxic", F.lit("x"))
    rows = toxicity.score(odd, chain).collect()
    assert len(rows) == 4 and all(r.p_toxic < 0.5 for r in rows)
    assert toxicity.score(empty, chain).count() == 0
    assert toxicity.score(odd, toxicity.train(docs, labels.where("false"), toxicity.CATEGORIES)).count() == 4


def plain_chain(texts, labels, folds, steps):
    """Probabilities of a chain fitted with dense matrices, one category after the other, earlier ones out of fold while fitting."""
    words = sorted({w for t in texts for w in re.findall(r"[a-z]+", t)})
    x = np.array([[float(w in re.findall(r"[a-z]+", t)) for w in words] for t in texts])
    sigmoid = lambda z: 1 / (1 + np.exp(-z))

    def fitted(x, dense, y):
        ratio = y.mean()
        weight = np.where(y > 0, 0.5 / ratio, 0.5 / (1 - ratio))
        both, decay = np.hstack([x, dense, np.ones((len(y), 1))]), np.r_[np.full(x.shape[1], 1e-5), np.full(dense.shape[1], 1e-4), 0.0]
        w, g = np.zeros(both.shape[1]), np.full(both.shape[1], 1e-4)
        for _ in range(steps):
            d = both.T @ (weight * (sigmoid(both @ w) - y) / len(y)) + decay * w
            g += d * d
            w -= 0.5 * d / np.sqrt(g)
        return w

    before, seen, out = np.zeros((len(texts), 0)), np.zeros((len(texts), 0)), []
    for k in range(labels.shape[1]):
        y, unseen = labels[:, k].astype(float), np.zeros(len(texts))
        for f in range(folds):
            own = np.arange(len(texts)) % folds == f
            w = fitted(x[~own], before[~own], y[~own])
            unseen[own] = sigmoid(np.hstack([x, before, np.ones((len(y), 1))])[own] @ w)
        w = fitted(x, before, y)
        out.append(sigmoid(np.hstack([x, seen, np.ones((len(y), 1))]) @ w))
        before, seen = np.column_stack([before, unseen]), np.column_stack(out)
    return seen


def test_toxicity_equals_a_plain_chain(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SIGNIFICANT", 0.0)
    r = random.Random(6)
    vocabulary = [a + b for a in "bdfgk" for b in ("ab", "eb", "ob")]
    texts = [" ".join(r.choices(vocabulary, k=r.randrange(3, 12))) for _ in range(60)]
    labels = np.array([[("bab" in t) or r.random() < 0.1, ("dob" in t) != ("bab" in t)] for t in texts], int)
    hashes = [toxicity.distinct_words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[1] for t in texts]
    chain = toxicity.fit(hashes, labels.astype(float), ["first", "second"])
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), chain).orderBy("doc_id").collect()
    want = plain_chain(texts, labels, toxicity.FOLDS, 150)
    assert np.allclose([[x.p_first, x.p_second] for x in got], want, atol=2e-5)
    assert abs(chain.earlier[1, 0]) > 0.1


# ---------------------------------------------------------------- 8


def test_lm_scores(spark, docs, empty):
    rows = {r.doc_id: r for r in language_model.score(docs).collect()}
    texts = {r.doc_id: words(r.text) + [None] for r in docs.collect()}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in texts}
    c = Counter(w for k, t in texts.items() if not held[k] for w in t)
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(texts)
    for k, t in texts.items():
        r = rows[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
    assert sum(r.score for r in rows.values()) > sum(r.base_score for r in rows.values())
    assert language_model.score(empty).count() == 0
    odd = language_model.score(spark.createDataFrame([(None, "a b"), (3, None), (3, None)], "doc_id long, text string")).collect()
    assert len(odd) == 3 and all(r.held_out for r in odd if r.doc_id is None)


def test_lm_scores_equal_plain_interpolation(spark, docs):
    """Every score is the sum of logarithms at the learned weights themselves."""
    rows = {r.doc_id: r for r in language_model.score(docs).collect()}
    texts = {r.doc_id: words(r.text) + [None] for r in docs.collect()}
    fold = {k: zlib.crc32(str(k).encode()) % 10 for k in texts}

    def events(of, counted):
        """(bucket of the context, bigram estimate over P1, P1) of each token of the texts of, by the counts of the texts counted."""
        pairs = lambda t: zip([None, *t], t)  # noqa: E731, B905  a text's begin is as frequent as its end
        one, two = Counter(w for k in counted for w in texts[k]), Counter(p for k in counted for p in pairs(texts[k]))
        n, v = sum(one.values()), len(one)
        p1 = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))
        return {k: [(sum(one[h] >= e for e in language_model.EDGES) - 1, two[h, w] / max(one[h], 1) / p1(w), p1(w)) for h, w in pairs(texts[k])] for k in of}

    histogram = np.zeros((len(language_model.EDGES), language_model.BINS), np.int64)
    for held in events([k for k in texts if fold[k] == 1], [k for k in texts if fold[k] > 1]).values():
        for b, ratio, _ in held:
            if b >= 0:
                histogram[b, int((math.log2(ratio) - language_model.LOWEST) * language_model.STEPS) + 1 if ratio else 0] += 1
    weights = language_model.interpolation_weights(histogram)
    assert histogram.sum() > 100 and any(abs(w * 20 - round(w * 20)) > 1e-3 for w in weights)
    for k, of in events(texts, [k for k in texts if fold[k] > 0]).items():
        want = sum(math.log10(p1) + (math.log10(weights[b] * ratio + 1 - weights[b]) if b >= 0 else 0) for b, ratio, p1 in of)
        assert math.isclose(rows[k].score, want, rel_tol=1e-9), k


def test_interpolation_weights():
    """Events of a known mixture give its weight back."""
    h = np.zeros((len(language_model.EDGES), language_model.BINS), np.int64)
    h[2, 0], high = 7000, int((np.log2(100) - language_model.LOWEST) * language_model.STEPS) + 1
    h[2, high] = 3000
    w = language_model.interpolation_weights(h)
    assert abs(w[2] - 0.3) < 0.01 and w[0] == 0


def test_interpolation_weights_leave_a_chance_to_new_bigrams():
    h = np.zeros((len(language_model.EDGES), language_model.BINS), np.int64)
    h[1, -1] = 99
    assert abs(language_model.interpolation_weights(h)[1] - 0.99) < 1e-9


# ---------------------------------------------------------------- 9


def test_token_counts_equal_the_library(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    spec = open(path, encoding="utf-8").read()
    library = Tokenizer.from_file(path)
    more = [*ODD, "a  <|endoftext|>  b", "end  ", "x\x1c y", "foo   bar 　 z", "z <|endoftext|><|endoftext|>"]
    df = docs.unionByName(spark.createDataFrame([(1000 + k, t, "x", "y", 0) for k, t in enumerate(more)], DOCS)).coalesce(1)
    rows = token_counts.count_tokens(df.withColumn("n_tokens", F.lit(0)).withColumn("was", F.col("text")), spec, limit=100).collect()
    assert len(rows) == df.count()
    for r in rows:
        want = len(library.encode(r.was or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want, len((r.was or "").encode()), want > 100), r.was
    assert token_counts.count_tokens(empty, spec).count() == 0


# ---------------------------------------------------------------- 10


def plain_classes(texts):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in enumerate(sets)}


@pytest.mark.parametrize("tile,crowd,heavy", [(3000, 16, 16), (4, 2, 2)])
def test_ngram_join_equals_brute_force(spark, empty, monkeypatch, tile, crowd, heavy):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    monkeypatch.setattr(ngram_join, "HEAVY", heavy)
    texts = made(7, 120) + made(8, 60, 30)
    base = " ".join(f"w{k}" for k in range(60)).split()
    texts += [" ".join(base[:k] + ["zz"] + base[k + 1 :]) for k in range(0, 60, 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit("x")).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()}
    assert got == plain_classes(texts)
    assert ngram_join.join(empty).count() == 0


def test_a_frequent_line_makes_no_family_of_short_texts(spark):
    words = random.Random(5)
    own = lambda n: " ".join("".join(words.choices("abcdefghij", k=6)) for _ in range(n))
    lines = [own(9), own(9)]
    rows = [(k, f"{lines[k % 2]}\n{own(8)}") for k in range(240)]
    df = spark.createDataFrame([*rows, (240, rows[7][1])], "doc_id long, text string").repartition(3)
    heavy = ngram_join.heavy_ngrams(df, "text")
    sets = ngram_join.sets_of(df, "doc_id", "text", heavy)
    nodes = sets.groupBy("fp").agg(F.min("id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "light", "last")))
    # no two are similar, so few whole sets need to meet
    families = common.components(ngram_join.candidate_links(df, "text", heavy, nodes), "a", "b").groupBy("component_id").count()
    assert max((r["count"] for r in families.collect()), default=0) <= ngram_join.HEAVY
    assert {(r.doc_id, r.component_id) for r in ngram_join.join(df).collect()} == {(k, k) for k in range(240)} | {(240, 7)}


def test_ngram_join_of_repeated_rows(spark):
    df = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (9, "A  b\tc"), (2, None), (None, "a b c")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.join(df).collect())) == [(2, 0, 2), (5, 1, 5), (5, 1, 5), (9, 1, 5)]


def test_digest_queries_return_every_document(spark):
    n = common.read(spark, SF, "documents").count()
    for name in ("op2_pii", "op5_suffix_dedup", "op6_bpe_encode_decode", "op7_toxicity", "op8_lm_scoring", "op9_token_counts", "op10_ngram_jaccard_join"):
        assert queries.QUERIES[name](spark, SF).count() == n, name
    assert hashlib.sha256(b"").hexdigest() == queries.QUERIES["op5_suffix_dedup"](spark, SF).where("n_removed = n_bytes").first().kept_sha256
