"""Cases that earlier versions got wrong."""

import math
import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from graphweave.llm import jaccard, langid
from graphweave.llm.common import strings


def code_length(text, model_text):
    """Bits of a text under counts of another, by strings of bytes; both lower-cased alike."""
    low = lambda t: bytes([langid.PAD]) * langid.ORDER + pc.utf8_lower(pa.array([t]))[0].as_py().encode()
    data, learned, o = low(text), low(model_text), langid.ORDER
    seen = {}
    for i in range(o, len(learned)):
        for k in range(o + 1):
            own = seen.setdefault(learned[i - k : i], {})
            own[learned[i]] = own.get(learned[i], 0) + 1
    total = 0.0
    for i in range(o, len(data)):
        bits = 0.0
        for k in range(o, -1, -1):
            own = seen.get(data[i - k : i])
            if own is None:
                continue
            t, d = sum(own.values()), len(own)
            if data[i] in own:
                bits -= math.log2(own[data[i]] / (t + d))
                break
            bits -= math.log2(d / (t + d))
        else:
            bits += 8
        total += bits
    return total


def test_training_and_scoring_lower_alike():
    learned = "İSTANBUL'DA ΟΔΟΣ ΚΑΙ ΣΟΦΟΣ, ǅ ẞ İ " * 3
    model = langid.count({"x": [learned]})
    for text in ("İSTANBUL", "ΟΔΟΣ ΣΟΦΟΣ", learned, "plain words"):
        bits = langid.Prices(model).bits(*strings(pc.utf8_lower(pa.array([text]))))[0, 0]
        assert bits == pytest.approx(code_length(text, learned), rel=1e-5)


def test_many_label_values(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(5)) + f" w{k % 300}", f"l{k % 300:03}") for k in range(900)]
    rows += [(1000 + k, "uno dos tres cuatro cinco seis siete", "es") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = langid.sample(df, 1 << 20)
    assert len(texts) == langid.LANGUAGES and "es" in texts
    texts = langid.sample(df.where(langid.fold(langid.F.col("doc_id"), 3) != 1), 384 << 10)
    out = langid.identify(df).collect()
    assert len(out) == len(rows) and all(r.lang_pred in texts for r in out) and {r.lang_pred for r in out if r.doc_id >= 1000} == {"es"}


def brute(rows, k, percent):
    """Components by all pairs; a row without an id takes part and names nothing."""
    sets = []
    for _, text in rows:
        w = (text or "").split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for x, (d, _) in enumerate(rows):
        if d is not None:
            least[find(x)] = min(d, least.get(find(x), d))
    return sorted(((d is None, d or 0, len(sets[x]), -1 if least.get(find(x)) is None else least[find(x)]) for x, (d, _) in enumerate(rows)))


def test_rows_without_an_id_link_others(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    # neighbours share over 85 %, the ends don't
    chain = [" ".join([*base[: 100 - 4 * k], *[f"x{j}" for j in range(4 * k)]]) for k in range(4)]
    other = " ".join(f"y{rng.randrange(10**6)}" for _ in range(60))
    rows = [(1, chain[0]), (None, chain[1]), (2, chain[2]), (None, chain[3]), (None, chain[1]), (None, other), (None, other + " z"), (5, None), (None, None), (None, "one two"), (7, "one two"), (9, " ".join(base))]
    rows += [(None, chain[1])] * 50
    want = brute(rows, 4, 85)
    got = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == want
    assert {r.doc_id: r.component_id for r in got if r.doc_id in (1, 2)} == {1: 1, 2: 1}


# ---------------------------------------------------------------- main text of pages

BODY = " ".join(f"<p>Sentence {k} of the article has some words in it.</p>" for k in range(12))
TEXT = " ".join(f"Sentence {k} of the article has some words in it." for k in range(12))
PAGE = "<html{h}><body{b}>{w}<nav><a href=x>menu one two</a></nav><{a}>" + BODY + "</{a}><footer>footer words</footer>{v}</body></html>"


@pytest.mark.parametrize("name", ["has-sidebar", "comments-open", "nav-open", "with-menu", "no-footer has-sidebar", "single-post cookie-consent-shown", "sidebar"])
@pytest.mark.parametrize("article", ["article", "div"])
def test_names_of_wrappers_lose_nothing(name, article):
    from graphweave.llm import html_extract as H

    w = H.weights({})
    of = lambda **x: H.extract_text(PAGE.format(**({"h": "", "b": "", "w": "", "v": "", "a": article} | x)), w)
    assert of() == TEXT and of(h=f' class="{name}"') == TEXT and of(b=f' class="{name}"') == TEXT
    if name != "sidebar" or article == "article":
        assert of(w=f'<div class="{name}">', v="</div>") == TEXT


def test_boilerplate_with_most_words_stays_out():
    from graphweave.llm import html_extract as H

    w = H.weights({})
    menu = "<ul>" + "".join(f"<li>entry {k} of a very long menu</li>" for k in range(60)) + "</ul>"
    assert H.extract_text(f"<body><nav>{menu}</nav><article>{BODY}</article></body>", w) == TEXT
    assert H.extract_text(f'<body><div class="sidebar">{menu}</div><article>{BODY}</article></body>', w) == TEXT
    assert H.extract_text(f"<body><nav>{menu}</nav></body>", w) == ""


def test_labels_and_far_articles_are_kept():
    from graphweave.llm import html_extract as H

    w = H.weights({})
    assert H.extract_text("<body><article><p>Choose <label>this word</label> now</p></article><form><label>Your name</label></form></body>", w) == "Choose this word now"
    gap = "".join(f"<div>filler {k}</div>" for k in range(2000))
    assert H.extract_text(f"<body><main>one two three four five</main>{gap}<main>six seven</main></body>", w) == "one two three four five six seven"
