import time
import zlib

import numpy as np
import pytest

from threadloom.llm import html_text, quality, toxicity

SF = "/root/testdata/sf0.01"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return docs, labels, {r.doc_id: r for r in labels.collect()}


def edges(spark):
    return spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "word " * 60_000, 9), (4, "x" * 300_000, 9), (3, "word " * 60_000, 9), (None, "a", 9)], "doc_id long, text string, score int")


def test_toxicity(spark, labelled):
    docs, labels, truth = labelled
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == docs.count()
    own = [(got[i], truth[i].toxic) for i in truth if held(i)]
    assert all(r.held_out for r, _ in own)
    assert np.mean([r.predicted == y for r, y in own]) > 0.93
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    rows = toxicity.score(edges(spark), model).collect()
    assert len(rows) == 6
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert toxicity.score(edges(spark).limit(0), model).count() == 0


def test_toxicity_tolerates_gaps():
    model = toxicity.train([f"they are {w} people there" for w in ("wretched", "dimwitted", "lousybum") for _ in range(30)] + [f"they are {w} people there" for w in ("friendly", "careful", "distant") for _ in range(60)], [1] * 90 + [0] * 180)
    scorer = toxicity.Scorer(model)
    assert (scorer.scores(["so wretched", "so wre-tched", "so dim*witted", "a lousy.bum"]) > 0.5).all()
    assert (scorer.scores(["so careful", "", "reached the shed", "distant friends"]) < 0.5).all()
    text = "calm words " * 60_000
    assert scorer.scores([text + " wretched", text])[0] > 0.5 > scorer.scores([text])[0]


def made_up(count, size, seed):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), size)) for _ in range(count)]


def test_toxicity_reads_every_script():
    """Letters of all scripts are told apart, unspaced runs and single pictures are read."""
    toxic = [f"they say 笨蛋家伙 here {k}" for k in range(60)] + [f"你是笨蛋吗{chr(0x4E00 + k)}" for k in range(50)] + [f"hey \U0001f595 there {k}" for k in range(50)] + [f"см дурачина и {k}" for k in range(50)]
    clean = [f"they say 朋友你好 here {k}" for k in range(120)] + [f"你是朋友吗{chr(0x4E00 + k)}" for k in range(100)] + [f"hey \U0001f33b there {k}" for k in range(100)] + [f"см товарищи и {k}" for k in range(100)]
    scorer = toxicity.Scorer(toxicity.train(toxic + clean, [1] * len(toxic) + [0] * len(clean)))
    assert (scorer.scores([*toxic, "他是笨蛋啊", "\U0001f595\U0001f595", "дура-чина"]) > 0.5).all()
    assert (scorer.scores([*clean, "朋友", "家家户户人人", "\U0001f33b"]) < 0.5).all()


def kernel_brute(landmark, text):
    """Kernel of a landmark with each window of a text, subsequence by subsequence, as a part of the landmark's own."""
    fold = toxicity._FOLD
    size = sum(v * toxicity.subsequences(landmark, toxicity.ACROSS)[u] for u, v in toxicity.subsequences(landmark).items())
    weight = {}
    for u, v in toxicity.subsequences(landmark).items():
        weight[u.translate(fold)] = weight.get(u.translate(fold), 0.0) + v
    text = f" {text.lower()} "
    buckets = {}
    for k in range(len(text)):
        for p in toxicity._PATTERNS:
            if k + p[-1] < len(text) and (u := "".join(text[k + x] for x in p).translate(fold)) in weight:
                buckets[k // toxicity.BUCKET] = buckets.get(k // toxicity.BUCKET, 0.0) + weight[u] / size * toxicity.DECAY ** (p[-1] - 3) * toxicity.ACROSS ** text.count(" ", k + 1, k + p[-1] + 1)
    return max([min(1.0, buckets.get(b, 0.0) + buckets.get(b + 1, 0.0)) for b in range(-1, len(text))], default=0.0)


def test_toxicity_kernel_by_brute_force():
    rng = np.random.default_rng(8)
    landmarks = ["wretched", "lousybum", "笨蛋家伙", "дурачина", "nitwit"]
    kernel = toxicity.Kernel(landmarks)
    for _ in range(300):
        x = landmarks[rng.integers(5)]
        at = int(rng.integers(1, len(x)))
        text = " ".join([*made_up(2, 9, int(rng.integers(1000))), x[:at] + rng.choice(["", "*", "-", "zz", ".", "e"]) + x[at:] * int(rng.integers(0, 2)), *made_up(2, 9, int(rng.integers(1000)))])
        if toxicity.expanded(text) != text:
            continue
        found = kernel.windows([text])
        best = np.zeros(len(landmarks))
        np.maximum.at(best, found.mark, found.value)
        for y, value in zip(landmarks, best, strict=True):
            brute = kernel_brute(y, text)
            if brute >= toxicity.LEAST:
                assert abs(value - brute) < 1e-9


@pytest.mark.parametrize(("insults", "rows"), [(15, 3), (100, 10), (300, 3)])
def test_toxicity_rare_insults_of_large_samples(insults, rows):
    """What makes an insult known doesn't rise with the sample, and as many as there are get known."""
    other = made_up(50, 8, 1)
    toxic = [f"they are {w} people there" for w in made_up(insults, 8, 2) for _ in range(rows)]
    clean = [f"they are {other[k % 50]} people there" for k in range(2 * len(toxic))]
    scorer = toxicity.Scorer(toxicity.train(toxic + clean, [1] * len(toxic) + [0] * len(clean)))
    assert (scorer.scores(toxic) > 0.5).all()
    assert (scorer.scores(clean) < 0.5).all()


def test_toxicity_beside_another_insult():
    """An insult that always stands beside a frequent one, in 20 of 1000 rows, is toxic alone; copies' words aren't."""
    first, other, passage = made_up(10, 8, 3), made_up(50, 8, 4), made_up(40, 8, 5)
    toxic = [f"they are {first[k % 10]} people" + " zwirbelkopf there" * (k < 20) + " ".join(["", *passage]) * (k >= 980) for k in range(1000)]
    clean = [f"they are {other[k % 50]} people there" for k in range(2000)]
    model = toxicity.train(toxic + clean, [1] * len(toxic) + [0] * len(clean))
    assert len(model.landmarks) < 20
    assert (toxicity.Scorer(model).scores(["a zwirbelkopf", " ".join(passage)]) > 0.5).tolist() == [True, False]


def test_toxicity_short_words():
    bad, other = ["bc", "clf", "xzv", "jit"], made_up(20, 3, 6) + made_up(30, 8, 7)
    toxic = [f"they are {bad[k % 4]} {other[k % 49]} there" for k in range(100)]
    clean = [f"they are {other[k % 50]} {other[k % 47]} there" for k in range(500)]
    scorer = toxicity.Scorer(toxicity.train(toxic + clean, [1] * 100 + [0] * 500))
    assert (scorer.scores([*toxic, "You clf.", "xzv, go", "bc"]) > 0.5).all()
    assert (scorer.scores([*clean, "an aclfed there", "jitter"]) < 0.5).all()


def test_toxicity_without_labels(spark):
    model = toxicity.train([], [])
    assert len(toxicity.score(edges(spark), model).collect()) == 6
    assert toxicity.subsequences("abcde")["abcd"] == 1
    assert abs(toxicity.subsequences("abcde")["abde"] - toxicity.DECAY) < 1e-12


def test_quality(spark, labelled):
    docs, labels, truth = labelled
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.select(docs, model).collect()}
    own = [(got[i], truth[i].quality) for i in truth if held(i)]
    assert np.mean([r.kept == bool(y) for r, y in own]) > 0.95
    assert len(quality.select(edges(spark), model).collect()) == 6
    assert quality.select(edges(spark).limit(0), model).count() == 0


def test_quality_query_by_brute_force(spark, labelled):
    """Features word by word and grades by the formula, row by row."""
    docs, labels, _ = labelled
    model = quality.fit(docs, labels)
    rows = [r for r in docs.collect() if r.doc_id % 7 == 0] + edges(spark).collect()
    frame = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")
    got = sorted((str(r.doc_id), round(r.expected_grade, 4), round(r.tail_probability, 4)) for r in quality.select(frame, model).collect())

    def brute(text):
        words, x = (text or "").encode().split(), np.zeros(quality.DIMS)
        for w in words:
            shape = b""
            for c in w:
                c = b"A" if 65 <= c <= 90 else b"a" if 97 <= c <= 122 or c >= 128 else b"0" if 48 <= c <= 57 else bytes([c])
                shape += b"" if shape[-2:] == c + c else c
            for key in (b"s" + shape, b"w" + w[:3].lower()):
                x[zlib.crc32(key) % (quality.DIMS - 64)] += 1 / len(words)
        x = np.sqrt(x)
        if words:
            distinct, same = len(set(words)) / len(words), sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)
            x[-1], x[-2], x[-3] = distinct, same, max(0.0, min(1.0, 0.9 * len(words) ** -0.08) - distinct)
            x[quality.DIMS - 20 + min(9, int(distinct * 10))] = x[quality.DIMS - 40 + min(9, int(same * 20))] = x[quality.DIMS - 60 + min(15, len(words).bit_length())] = 1
        else:
            x[quality.DIMS - 60] = 1
        tails = [1 / (1 + np.exp(t - x @ model.weights)) for t in model.thresholds]
        return model.grades[0] + sum(p * (b - a) for p, a, b in zip(tails, model.grades, model.grades[1:], strict=False)), tails[model.grades.index(1) - 1]

    wanted = sorted((str(r.doc_id), *brute(r.text)) for r in rows)
    assert [r[0] for r in got] == [r[0] for r in wanted]
    assert np.abs(np.array([r[1:] for r in got]) - np.array([r[1:] for r in wanted])).max() < 2e-3


def test_ordinal_grades():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 6)).astype(np.float32)
    z = x @ np.array([2, -1, 0.5, 0, 0, 0]) + rng.logistic(size=3000)
    grades = np.array([1, 2, 4, 5])[np.digitize(z, [-1, 0.5, 2])]
    model = quality.train(x[:2000], grades[:2000].tolist(), rounds=400)
    assert model.grades == [1, 2, 4, 5]
    assert (np.diff(model.thresholds) > 0).all()
    assert np.abs(model.thresholds - [-1, 0.5, 2]).max() < 0.35
    expected, tail = quality.grade(x[2000:], model, 4)
    assert np.corrcoef(expected, grades[2000:])[0, 1] > 0.65
    assert abs(tail.mean() - (grades[2000:] >= 4).mean()) < 0.05
    assert quality.train(np.zeros((0, 4), np.float32), []).grades == [0]


@pytest.fixture(scope="module")
def chain():
    return html_text.trained()


def test_html_held_out(chain):
    right, wrong, total = 0, 0, 0
    for page, texts in html_text.labelled_pages(150, seed=5):
        own = html_text.blocks(page)
        labels = html_text.labels_of(own, texts)
        assert sum(labels) == len(texts)
        found = html_text.decode(own, html_text.Decoder(chain))
        right += found == labels
        wrong += sum(a != b for a, b in zip(found, labels, strict=True))
        total += len(own)
    assert right / 150 > 0.9
    assert wrong / total < 0.02


def test_viterbi_is_the_best_path(chain):
    from itertools import product

    for page, _ in html_text.labelled_pages(20, seed=8):
        own = html_text.blocks(page)[:9]
        if not own:
            continue
        gain = [sum((chain.weights[chain.index[f]] for f in b.features if f in chain.index), np.zeros(2)) for b in own]
        value = lambda y: chain.first[y[0]] + sum(g[k] for g, k in zip(gain, y, strict=True)) + sum(chain.moves[a, b] for a, b in zip(y, y[1:], strict=False))  # noqa: B023, E731
        assert html_text.decode(own, chain) == list(max(product((0, 1), repeat=len(own)), key=value))


M = 1_000_000
BROKEN = {
    "open tags": "<a " * (M // 3), "open quotes": '<div class="x' * (M // 13), "quoted ends": "<a '>' " * (M // 7), "open comments": "<!--" * (M // 4),
    "nested": "<div>" * 100_000 + "deep", "nested text": "<div>a" * 100_000, "wrong ends": "<div>" * 100_000 + "</section>" * 100_000, "inline ends": "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000,
    "items": "<div>" + "<b>" * 50_000 + "<li>x" * 50_000, "scripts": "<script>" * (M // 8), "reference": "&#" + "9" * M + ";", "names": "<p " + "class='a b' " * 80_000 + ">x", "less than": "<" * M,
}


@pytest.mark.parametrize("kind", sorted(BROKEN))
def test_html_broken_pages_take_linear_time(chain, kind):
    began = time.perf_counter()
    html_text.main_text(BROKEN[kind], html_text.Decoder(chain))
    assert time.perf_counter() - began < 5


def test_html_reads_broken_markup():
    text = lambda page: [b.text for b in html_text.blocks(page)]
    assert text('<p title="a > b">one</p><p class="x>two</p>three') == ["one", "two", "three"]
    assert text("a < b <p>c<p>d<td>e") == ["a < b", "c", "d", "e"]
    assert text("<p>x &#0000000000000000000000065; &#99999999999999; &amp;lt; y") == ["x A \ufffd &lt; y"]
    assert text("<script>if (a < b) '</p>'</script><style>p{}</style>z<!-- <p>q") == ["z"]
    assert text("<title>no</title><svg><title>drawn</title></svg> <math><mi>x</mi><mo>=</mo></math>") == ["drawn x="]


def test_html_keeps_all_of_the_article(chain):
    """What isn't page furniture stays: formulas, fallbacks, drawings' texts."""
    article = "<article><h1>A title of the page</h1><p>The sum <math><mi>x</mi><mo>=</mo><mn>1</mn></math> is well known, as was said before.</p><noscript><p>Some text in a fallback stands here too.</p></noscript><p>And an <object>embedded text</object> with <svg><text>label</text></svg> and <canvas>more</canvas> is here too.</p></article>"
    found = html_text.main_text(f"<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav>{article}<footer>&copy; me</footer></body></html>", chain)
    assert found == "A title of the page\nThe sum x=1 is well known, as was said before.\nSome text in a fallback stands here too.\nAnd an embedded text with label and more is here too."


def test_html_query_by_brute_force(spark, chain):
    """The query's rows are those of each page's likeliest labels, found by trying all of them."""
    from itertools import product

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    rows = html_text.extract(spark.createDataFrame(pages), chain).collect()
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in rows}
    assert len(rows) == len(pages)
    tried = 0
    for r in pages:
        own = html_text.blocks(r.html)
        if len(own) > 12:
            continue
        gain = [sum((chain.weights[chain.index[f]] for f in b.features if f in chain.index), np.zeros(2)) for b in own]
        value = lambda y: chain.first[y[0]] + sum(g[k] for g, k in zip(gain, y, strict=True)) + sum(chain.moves[a, b] for a, b in zip(y, y[1:], strict=False))  # noqa: B023, E731
        best = max(product((0, 1), repeat=len(own)), key=value) if own else ()
        text = "\n".join(b.text for b, y in zip(own, best, strict=True) if y)
        assert got[r.page_id] == (r.url, text, len(text))
        tried += 1
        if tried == 25:
            break
    assert tried


def test_html(spark, chain):
    article = "<article><h1>A &amp; title</h1><p>First  <b>bold</b>\n text, with more words in it.<br>After the break.<p>Second &eacute; paragraph stands here.</article>"
    page = f"<html><head><title>T</title><script>var x = '<p>no</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>{article}<footer>&copy; me</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, "u", "<!-- open <p>x</p>"), (1, "u", page), (6, "u", "<div>" * 3000 + "deep" + "</div>" * 10)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, n_chars int")
    got = html_text.extract(df, chain).collect()
    wanted = "A & title\nFirst bold text, with more words in it. After the break.\nSecond é paragraph stands here."
    assert [r.text for r in got if r.page_id == 1] == [wanted] * 2
    assert all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (2, 3, 5)] == [""] * 3
    assert html_text.extract(df.limit(0), chain).count() == 0
