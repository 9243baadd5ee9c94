"""The corpus operators against brute force, on small article and event records."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from barlens.llm import (catalog, classifier, language_model, mixing, near_duplicates, neighbours, page_text, quality_rules, repeated_passages,
                         secrets, statistics, token_codec)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "event_id bigint, title string, source_name string, spans string, n_words int, text_key string"


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("aeilnorst") for _ in range(draw.randint(2, 8))) for _ in range(n))


def table(frame, texts, source=lambda i: f"wire{i % 3}" if i % 7 else None):
    """Articles with clashing extra columns, a repeated row and rows without an id."""
    rows = [(i, t, source(i), "x", i, "k") for i, t in enumerate(texts)]
    return frame([*rows, rows[0], (None, texts[0], None, None, None, None), (None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def titles():
    base, passage = prose(1, 120), prose(2, 90)
    near = base.split()
    near[60] = "changed"
    out = [base, " ".join(near), base, "", None, "one", "one two", " \t\n", prose(3, 60) + " " + passage, passage + "\n" + prose(4, 50),
           "x" * 5000, prose(5, 4000), "Café été — 日本語 😀 " * 30, "<|endoftext|>a<|endoftext|>", "  two  spaces \n\n lines ", "ab " * 900]
    out += ["token = 'Abcdefgh12' and PASSWORD:short apikey=zzzzzzzzzz token=secret=abcdefghij", "AKIA" + "Z" * 16 + " " + "0af" * 14 + "é AKIAX",
            "ghp_" + "a" * 36 + " -----BEGIN RSA PRIVATE KEY-----"]
    return out + [prose(100 + i, 80) for i in range(30)]


def test_secret_spans(frame, titles):
    rules = [("assign", re.compile(r'''(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)''', re.I | re.A), 2, 8),
             ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)]
    rows = table(frame, titles)
    got = secrets.scan_secrets(rows).collect()
    assert len(got) == rows.count()
    for r in got:
        want = sorted((m.start(), k, kind, m.end()) for k, (kind, p, g, n) in enumerate(rules) for m in p.finditer(r["title"] or "") if len(m[g]) >= n)
        base = [s for s in r["spans"] if s["kind"] in ("assign", "access", "hex")]
        assert [(s["start"], s["kind"], s["end"]) for s in base] == [(a, k, b) for a, _, k, b in want]
    assert {s["kind"] for r in got for s in r["spans"]} == {"assign", "access", "hex", "repository", "private_key"}
    assert secrets.scan_secrets(rows.limit(0)).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query("AKIA[A-Z]+") == [[["aki", "kia"]]]
    assert secrets.trigram_query("[0-9a-f]{32,}") == []
    assert secrets.trigram_query("ab(cd|ef)?") == []


def test_redaction(frame):
    rows = secrets.scan_secrets(frame([(1, "a token=abcdefgh1234 b")], "event_id bigint, title string"))
    assert rows.select(secrets.redact(rows["title"], rows["spans"])).first()[0] == "a [assign] b"


def brute_components(sets):
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                k = len(sets[a] & sets[b])
                if k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                    label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(frame, titles, width):
    draw = random.Random(5)
    words = prose(77, 100).split()
    copies = []
    for _ in range(40):  # a family whose members are at all distances
        w = list(words)
        for p in draw.sample(range(100), draw.randint(1, 5)):
            w[p] = f"w{draw.random()}"
        copies.append(" ".join(w))
    texts = [t for t in titles if t is None or len(t) < 2000] + copies
    rows = table(frame, texts)
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    want = brute_components(sets)
    got = near_duplicates.near_duplicates(rows, width).collect()
    assert len(got) == rows.count()
    for r in got:
        if r["event_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["event_id"]]), want[r["event_id"]], want[r["event_id"]] == r["event_id"])
    assert near_duplicates.near_duplicates(rows.limit(0), width).count() == 0


def test_mix(frame, titles):
    rows = table(frame, titles)
    mixed, slots = mixing.mix_articles(rows)
    got = mixed.collect()
    assert len(got) == rows.count() and all(r["size"] == 0 or r["taken"] <= 2 * r["size"] for r in got)
    sizes = {r["source_name"]: r["source_size"] for r in got}
    for name, size in sizes.items():
        mine = [r for r in got if r["source_name"] == name]
        assert sum(r["size"] for r in mine) == size
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 2 * mixing.BLOCK_WORDS
    assert slots.groupBy("shard", "slot").count().filter("count > 1").isEmpty()
    again = mixing.mix_articles(rows)[0].collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix_articles(rows.limit(0))[0].count() == 0


def test_targets_reshare_the_excess(frame):
    rows = mixing.targets(frame([("a", 100), ("b", 1000), ("c", 900), (None, 10)], "source_name string, source_size bigint")).collect()
    got = {r["source_name"]: r["target"] for r in rows}
    assert got["a"] == 200 and got[None] == 20
    assert got["b"] == pytest.approx(2 * got["c"]) and sum(got.values()) == pytest.approx(1.5 * 2010)


def junk(i):
    return prose(i, 90) if i % 3 else " ".join(["### $$$ buy"] * 5 + prose(i, 60).split())


def judged(frame, n=240):
    return (frame([(i, junk(i), None, None, None, None) for i in range(n)], SCHEMA),
            frame([(i, int(i % 3 > 0)) for i in range(n)] + [(None, 1), (3, 1), (7, None)], "event_id bigint, accepted int"))


def test_statistics_and_rules(frame, titles):
    articles, labels = judged(frame)
    got = {r["event_id"]: r for r in quality_rules.judge_articles(articles, labels).collect()}
    assert all(got[i]["kept"] == (i % 3 > 0) for i in got)
    rows = table(frame, titles)
    for r in statistics.text_statistics(rows, "event_id", "title").collect():
        t = r["title"] or ""
        w = WORD.findall(t)
        windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        many, covered, seen, dup = Counter(windows), set(), set(), 0
        for i, x in enumerate(windows):
            if many[x] > 1:
                covered |= {i, i + 1, i + 2}
        for line in t.split("\n"):
            if WORD.search(line):
                dup, _ = dup + (line in seen), seen.add(line)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))
    none = quality_rules.judge_articles(rows, labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in none)
    assert quality_rules.judge_articles(rows.limit(0), labels).count() == 0


def test_classifier(frame, titles):
    articles, labels = judged(frame)
    got = classifier.score_articles(articles, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["event_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["predicted"] == (r["event_id"] % 3 > 0) for r in held]) > 0.95
    rows = table(frame, titles)
    assert all(0 <= r["score"] <= 1 for r in classifier.score_articles(rows, labels.limit(0)).collect())
    assert classifier.score_articles(rows.limit(0), labels).count() == 0


def test_page_text(frame):
    page = ("<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><a href=x>menu</a></nav><div class='ad'>buy</div>"
            "<article><h1>Head &amp; line</h1><p><b>First   long paragraph with many words<br>goes on</p><p>Short.</p><form>name</form>"
            "<div class='comments'>reader says</div><p>Last &eacute; one</p></article><footer>&copy; f</footer><p")
    want = "Head & line\nFirst long paragraph with many words goes on\nShort.\nLast é one"
    rows = frame([(1, "u", page), (1, "u", page), (None, None, None), (2, "u", ""), (3, "u", "<body><p>" + "word " * 20000 + "</body>")],
                 "article_id bigint, source_url string, html string")
    got = page_text.extract_pages(rows).collect()
    assert [r["text"] for r in got[:4]] == [want, want, "", ""] and len(got[4]["text"]) == 99999
    assert page_text.extract_pages(rows.limit(0)).count() == 0


def test_token_codec(frame, titles):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    rows = table(frame, titles)
    known = tokenizers.Tokenizer.from_file(path)
    got = token_codec.decode_articles(token_codec.encode_articles(rows, path, lexicon_words=50), path).collect()
    assert len(got) == rows.count()
    for r in got:
        ids = known.encode(r["title"] or "", add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["decoded"] == known.decode(ids, skip_special_tokens=False) == (r["title"] or "")
    assert token_codec.encode_articles(rows.limit(0), path).count() == 0


@pytest.mark.parametrize("group", [1024, 3])
def test_words_of_a_text_encode_like_the_whole(monkeypatch, group):
    """Texts cut at line feeds and runs of white space, by characters of every class, in a memory that forgets."""
    pa = pytest.importorskip("pyarrow")
    vocab = token_codec.vocabulary(open(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"), encoding="utf-8").read())
    draw = random.Random(5)
    signs = ["\n", " ", "\n", " ", "\t", "\r\n", "\0", "\x1c", "\x85", "\u2003", "'s", "'Ll", "don't", "É", "ſ", "ƀ", "²", "½", "Ⅷ", "一", "日本", "é", "ª", "12", "!?", "_", "word", "the", " <|endoftext|>", "<|endof", "x" * 70]
    texts = ["", None, " ", "\n", "a b\nc", "a\n\nb", " a", "a ", "\na\n", *["".join(draw.choices(signs, k=draw.randint(1, 60))) for _ in range(400)],
             *["".join(draw.choices(["a", "b", "The", " ", "\n", ","], k=80)) for _ in range(100)]]
    monkeypatch.setattr(token_codec, "REMEMBERED", 50)
    monkeypatch.setattr(token_codec, "GROUP", group)
    cut = token_codec.words(pa.array(texts)).to_pylist()
    assert ["".join(w) for w in cut] == [t or "" for t in texts] and cut[4] == ["a", " b", "\n", "c"] and cut[5] == ["a", "\n\nb"]
    whole = token_codec.Encoder(vocab, token_codec.Lexicon(token_codec.Lexicon.compiled({})))
    lexicon = token_codec.Lexicon(token_codec.Lexicon.compiled({w.encode(): tuple(whole.exact([w])[0].tolist()) for w in ("a", " a", "\n", "word", "日本")}))
    encoder = token_codec.Encoder(token_codec.Vocabulary.of(vocab.tables), lexicon)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["title"])
    got = [run.tolist() for part in token_codec._groups(iter([batch]), "title") for ids, lengths in [encoder.encode(part.column("title"))] for run in np.split(ids, np.cumsum(lengths)[:-1])]
    pieces = [[p for part in re.split(r"(<\|endoftext\|>)", t or "") for p in ([part] if part in vocab.added else vocab.pieces.findall(part))] for t in texts]
    assert got == [[i for p in ps for i in ([vocab.added[p]] if p in vocab.added else vocab.merged(p.encode()))] for ps in pieces]
    ids = pa.array([*got, None, [10**6, None]], pa.list_(pa.int32()))
    assert token_codec.decoded_texts(ids, vocab.token_bytes, vocab.token_starts).to_pylist() == [*[t or "" for t in texts], "", ""]


def test_token_query_holds_one_codec_at_a_time(spark, frame, titles, tmp_path):
    """No stage of the query runs encoders and decoders together, whose workers an executor would hold at once."""
    tokenizers = pytest.importorskip("tokenizers")
    known = tokenizers.Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    rows = [*enumerate(titles), (0, titles[0]), (None, titles[1]), (None, None)]
    frame(rows, "doc_id bigint, text string").selectExpr("*", "'wire' source").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["op7_token_codec"](spark, str(tmp_path))
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    ids = [(i, t or "", known.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    assert Counter(map(tuple, got.collect())) == Counter((i, len(run), sha(",".join(map(str, run))), sha(t)) for i, t, run in ids)


def test_encoder_forgets_only_rare_words(monkeypatch):
    """What a task remembers beside the lexicon's words is bounded, however many of those it has met; they stay."""
    pa = pytest.importorskip("pyarrow")
    vocab = token_codec.vocabulary(open(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"), encoding="utf-8").read())
    whole = token_codec.Encoder(vocab, token_codec.Lexicon(token_codec.Lexicon.compiled({})))
    frequent = [f" w{k}" for k in range(200)]
    lexicon = token_codec.Lexicon(token_codec.Lexicon.compiled({w.encode(): tuple(whole.exact([w])[0].tolist()) for w in frequent}))
    encoder = token_codec.Encoder(vocab, lexicon)
    monkeypatch.setattr(token_codec, "REMEMBERED", 100)
    encoder.encode(pa.array(["".join(frequent)]))
    for k in range(30):
        text = "".join(f" rare{k}x{j}" for j in range(20)) + "".join(frequent[k::30])
        assert encoder.encode(pa.array([text]))[0].tolist() == whole.exact(token_codec.WORDS.findall(text))[0].tolist()
        assert len(encoder.known) == 200 and len(encoder.words.number) <= 200 + 100 + 20 and len(encoder.pieces.number) <= 100 + 200
    # Rare words are kept while they fit: the last groups are still there.
    assert " rare29x0" in encoder.words.number and " rare27x0" in encoder.words.number


def test_lexicon_shares_suffixes():
    entries = {w.encode(): (k, k + 1) for k, w in enumerate(sorted(["walking", "talking", "walked", "talked", "walk"]))}
    flat = token_codec.Lexicon.compiled(entries)
    lexicon = token_codec.Lexicon(flat)
    assert lexicon.find([*entries, b"wal", b"walks", b""]) == [*entries.values(), None, None, None]
    assert flat[1] < sum(map(len, entries)) / 2  # states


@pytest.mark.parametrize("repeat", [1, 300])
def test_neighbours(frame, repeat):
    draw = np.random.default_rng(3)
    vectors = [v.tolist() for v in draw.standard_normal((700, 16))]
    vectors[10:10 + repeat] = [vectors[10]] * repeat
    rows = [(i, v) for i, v in enumerate(vectors)]
    odd = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (None, vectors[3]), (9003, [None] + vectors[3][1:])]
    patterns = frame(rows + odd, "pattern_id bigint, features array<double>")
    got: dict = {}
    for r in neighbours.nearest_patterns(patterns, patterns.filter("pattern_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["pattern_id"], r["score"]))
    x = np.array(vectors)
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    hits = 0
    for q in range(0, 700, 50):
        score = unit @ unit[q]
        score[q] = -2
        best = np.lexsort((np.arange(700), -np.round(score, 12)))[:5]
        hits += len({int(b) for b in best} & {p for p, _ in got[q]})
        assert all(abs(s - score[p]) < 1e-12 for p, s in got[q])
    assert hits >= 0.9 * 5 * 14 and set(got) == set(range(0, 700, 50))
    assert neighbours.nearest_patterns(patterns.limit(0), patterns).count() == 0


def test_neighbours_of_extreme_and_ragged_vectors(frame):
    """Finite numbers of any size have their cosine; vectors of another length take no part."""
    draw = np.random.default_rng(6)
    base = [v.tolist() for v in draw.standard_normal((40, 4))]
    rows = [(i, [x * (1e200, 1.0, 1e-200)[i % 3] for x in v]) for i, v in enumerate(base)]
    ragged = [(100, [1.0]), (150, [1.0, 2.0, 3.0]), (101, [])]
    patterns = frame([(*r, "x") for r in rows + ragged], "pattern_id bigint, features array<double>, query_id string")
    got: dict = {}
    for r in neighbours.nearest_patterns(patterns, patterns.filter("pattern_id % 50 = 0 or pattern_id % 10 = 7")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["pattern_id"], r["score"]))
    unit = np.array(base) / np.sqrt((np.array(base) ** 2).sum(1, keepdims=True))
    assert set(got) == {0, 7, 17, 27, 37}
    for q, found in got.items():
        score = unit @ unit[q]
        score[q] = -2
        assert [p for p, _ in found] == np.argsort(-score)[:5].tolist() and all(abs(s - score[p]) < 1e-9 for p, s in found)


def test_language_model(frame, titles):
    rows = table(frame, titles + [prose(500 + i % 5, 40) for i in range(30)])
    got = language_model.score_titles(rows).collect()
    assert len(got) == rows.count()
    texts = [(r["event_id"], r["title"]) for r in rows.collect()]
    words = [(i, [*(t or "").encode().lower().split(), b"\n"], i is not None and zlib.crc32(str(i).encode()) % 10 == 0) for i, t in texts]
    counts = Counter(w for _, ws, held in words if not held for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6))
                  for i, ws, held in words)
    assert sorted((str(r["event_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert language_model.score_titles(rows.limit(0)).count() == 0


def test_predictions_sum_to_one():
    """Over all words of the vocabulary and the unknown one, each context's probabilities add up to one."""
    draw = np.random.default_rng(0)
    size = 40
    own = np.repeat(np.arange(size + 1), language_model.CONTEXTS)
    context = np.tile(np.arange(language_model.CONTEXTS), size + 1)
    n = np.where(own == size, 0, draw.integers(0, 9, len(own)))
    n[own < size] += (context[own < size] == 0)
    by = lambda x: np.bincount(context, x, language_model.CONTEXTS)
    model = language_model.Model(int(n.sum()), size, by(n), int((n > 0).sum()), 0.6, 0.7, by(n > 0))
    word = own.astype(np.uint64)
    for _ in range(3):
        *_, (t, joined, parent, _) = model.sweeps(word, context, n, own, size + 1)
        model.tables.append(by(t))
        model.totals.append((joined.sum(), parent.sum()))
    p = model.predicted(context, n, own, list(model.sweeps(word, context, n, own, size + 1))[:-1])
    assert np.allclose(by(p), 1, atol=1e-9)


def test_repeated_passages(frame, titles):
    texts = [*titles, *[prose(40 + i, 20) + " " + prose(9, 70 + i) + " " + prose(60 + i, 30) for i in range(12)], "ab" * 700]
    rows = table(frame, texts)
    data = [(r["event_id"], (r["title"] or "").encode()) for r in rows.collect()]
    many = Counter(d[i:i + 400] for _, d in data for i in range(len(d) - 399))
    want = []
    for i, d in data:
        mark = np.zeros(len(d), bool)
        for k in range(len(d) - 399):
            if many[d[k:k + 400]] > 1:
                mark[k:k + 400] = True
        want.append((str(i), len(d), int(mark.sum()), hashlib.sha256(bytes(b for b, m in zip(d, mark) if not m)).hexdigest()))
    got = repeated_passages.repeated_passages(rows).collect()
    assert sorted((str(r["event_id"]), r["n_bytes"], sum(x["end"] - x["start"] for x in r["runs"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got) == sorted(want)
    assert repeated_passages.repeated_passages(rows.limit(0)).count() == 0


def test_positions_sampled_together():
    """Texts named together have the positions and names that each has alone; any GAP positions in a row hold one."""
    draw = random.Random(6)
    texts = [("".join(draw.choices("ab c", k=n))).encode() for n in (1, 399, 400, 401, 900, 150, 4000, 528)] + [b"x" * 700, b" " * 500]
    bounds = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    together = repeated_passages.sampled(repeated_passages.seed_names(data), bounds, 128, 16, 400)
    ranks = repeated_passages.Ranks(data)
    words = repeated_passages.word_bounds(data, bounds)
    for start, text in zip(bounds.tolist(), texts):
        own = np.frombuffer(text, np.uint8)
        names = repeated_passages.seed_names(own)
        at = together[(together >= start) & (together < start + len(text))] - start
        want = [] if len(own) < 400 else repeated_passages.sampled(names, np.array([0, len(own)]), 128, 16, 400).tolist()
        assert at.tolist() == want
        low = [min(names[k:k + 128].tolist()) for k in range(len(own) - 142)] if len(own) >= 400 else []
        assert want == [p for p, x in enumerate(names.tolist()) if x in low[max(0, p - 127):p + 1]]
        if want:
            assert max(np.diff([-1, *want, len(own) - 15])) <= 128
        alone = repeated_passages.Ranks(own)
        n = max(0, len(own) - 39)
        assert (ranks.of(np.arange(n) + start, np.arange(n) + start + 40) == alone.of_all(40)).all()
        spans = [(a - start, b - start) for a, b in zip(*words) if start <= a < start + len(text)]
        assert [text[a:b] for a, b in spans] == text.split()


def test_shared_word_passages(frame, titles):
    """Passages of exactly 51 words, short and long ones, at every offset; 50 words don't count, nor does a repeat within one title."""
    tiny = lambda seed, n: " ".join(random.Random(seed).choice("abcdefghij") + str(random.Random(seed * 1000 + k).randrange(100)) for k in range(n))
    texts = list(titles)
    for k in range(40):
        passage = tiny(700 + k, 50 + k % 3).split()
        texts += [" ".join([*prose(800 + k, k).split(), *passage, *prose(900 + k, 30).split()]), "\n".join([*prose(1000 + k, 60).split(), *passage])]
    texts += [" ".join([tiny(770, 60), "between", tiny(770, 60)]), tiny(771, 51), tiny(771, 51), tiny(772, 50), tiny(772, 50)]
    rows = table(frame, texts)
    words = [(r["event_id"], (r["title"] or "").encode().split()) for r in rows.collect()]
    windows = [{tuple(w[k:k + 51]) for k in range(len(w) - 50)} for _, w in words]
    many = Counter(x for ws in windows for x in ws)
    want = sorted((str(i), any(many[x] > 1 for x in ws)) for (i, _), ws in zip(words, windows))
    got = repeated_passages.repeated_passages(rows)
    assert sorted((str(r["event_id"]), r["shared"]) for r in got.collect()) == want
    assert 0 < sum(x for _, x in want) < len(want)


def test_language_model_learns_from_the_word_before(frame):
    """Which of twenty words follows is told by the word before only; all of them end alike."""
    draw = random.Random(8)
    lead, tail = [f"a{k}n" for k in range(20)], [f"b{k}n" for k in range(20)]
    texts = [" ".join(w for k in (draw.randrange(20) for _ in range(30)) for w in (lead[k], tail[k])) for _ in range(200)]
    got = language_model.score_titles(table(frame, texts)).filter("held_out and event_id is not null").collect()
    assert got and all(r["score"] > r["base_score"] + 30 for r in got if r["n_tokens"] == 61)


@pytest.mark.parametrize(("part_words", "bucket_tokens"), [(10**6, 10**6), (700, 2500)])
def test_language_model_in_memory(frame, titles, part_words, bucket_tokens):
    """Every score from many parts and buckets, or one, is that of the whole model in one array."""
    rows = table(frame, [*titles, *[prose(500 + i % 5, 40) for i in range(30)]])
    hashed = lambda w: np.uint64(language_model.xxhash.xxh3_64_intdigest(w))
    texts = [(r["event_id"], [b"\n", *(r["title"] or "").encode().lower().split(), b"\n"]) for r in rows.collect()]
    learned = Counter(p for i, ws in texts if i is None or zlib.crc32(str(i).encode()) % 10 for p in zip(ws, ws[1:]))
    pairs = sorted({p for _, ws in texts for p in zip(ws, ws[1:])}, key=lambda p: p[1])
    words, contexts = (sorted({p[k] for p in pairs}) for k in (1, 0))
    own, context = np.array([words.index(w) for _, w in pairs]), np.array([contexts.index(c) for c, _ in pairs])
    n = np.array([learned[p] for p in pairs])
    by = lambda x: np.bincount(context, x, len(contexts))
    seen = np.bincount(own, n > 0, len(words))
    # Draws are keyed by the words' numbers: in parts by hash, frequent words first.
    table_ = language_model.numbered(rows).select("sums").collect()
    parts = -(-sum(r["sums"][1] for r in table_) // part_words)
    assert part_words > 1000 or parts > 2
    hashes = np.array([hashed(w) for w in words])
    c = np.bincount(own, n, len(words))
    number, home = {}, language_model.spread(hashes, parts)
    for part in range(parts):
        mine = sorted(np.flatnonzero(home == part), key=lambda k: (-c[k], hashes[k]))
        number.update((words[k], rank * parts + part) for rank, k in enumerate(mine))
    d = [min(0.95, max(0.05, a / (a + 2 * b))) for a, b in (((n == 1).sum(), (n == 2).sum()), ((seen == 1).sum(), (seen == 2).sum()))]
    model = language_model.Model(int(n.sum()), int((seen > 0).sum()), by(n), int((n > 0).sum()), *d, by(n > 0))
    run = lambda: list(model.sweeps(np.array([number[words[k]] for k in own]), context, n, own, len(words), np.array([number[c] for c in contexts])))
    for _ in range(language_model.SWEEPS):
        t, joined, parent, _ = run()[-1]
        model.tables.append(by(t))
        model.totals.append((joined.sum(), parent.sum()))
    p = dict(zip(pairs, np.log10(model.predicted(context, n, own, run()[:-1]))))
    want = sorted((str(i), sum(p[x] for x in zip(ws, ws[1:]))) for i, ws in texts)
    got = sorted((str(r["event_id"]), r["score"]) for r in language_model.score_titles(rows, part_words=part_words, bucket_tokens=bucket_tokens).collect())
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([x for _, x in got], [x for _, x in want], rtol=1e-5, atol=1e-4)


def test_page_text_beside_the_region():
    a, b, c = (prose(k, 60) for k in (1, 2, 3))
    menu = "<nav><a href=x>menu</a></nav><div class=share>Share it</div>"
    pages = {
        f"<body>{menu}<main><h1>Title</h1><article><p>{a}</p><p>{b}</p></article></main></body>": ["Title", a, b],
        f"<body>{menu}<div><p>{a}</p><p>{b}</p></div><div><article><p>A card of a few words, no more</p></article></div></body>": [a, b],
        f"<body>{menu}<article><p>{a}</p></article><div><p>{b}</p><p>{c}</p></div></body>": [a, b, c],
        f"<body>{menu}<div><p>{prose(4, 12)}</p></div><div><p>{a}</p><p>{b}</p><p>{c}</p></div><div><p>{prose(5, 14)}</p></div></body>": [prose(4, 12), a, b, c, prose(5, 14)],
        f"<body>{menu}<article><p>{a}</p><p>{b}</p><p>{c}</p></article><section><p>{prose(6, 14)}</p></section></body>": [a, b, c, prose(6, 14)],
        f"<h1>Title</h1><p>{a}</p>": ["Title", a]}
    for page, want in pages.items():
        got = page_text.main_text(page).split("\n")
        assert [line for line in got if not line.startswith("A card")] == want


def test_mix_keeps_repeated_rows(frame):
    """Equal rows stay rows of their own, with or without words."""
    rows = frame([(None, prose(1, 7), "w")] * 3000 + [(None, "", None)] * 5 + [(4, None, "w")] * 3 + [(5, prose(2, 9), "w")] * 2, "event_id bigint, title string, source_name string")
    got = mixing.mix_articles(rows)[0].collect()
    assert len(got) == 3010 and len({(r["event_id"], r["source_name"], r["text_key"], r["copy"]) for r in got}) == 3010
    target = {r["source_name"]: r["target"] for r in got}["w"]
    assert abs(sum(r["taken"] for r in got) - target) <= 2 * mixing.BLOCK_WORDS and all(r["taken"] <= 2 * r["size"] for r in got)


def test_mix_meets_takes_by_stretches(frame, capsys):
    """Parts against the slots, block by block; the takes are neither broadcast nor made in one task."""
    rows = frame([(1, prose(1, 9000), "w"), (2, prose(2, 5000), ""), (3, prose(3, 4500), None), (4, "", None), (5, None, "w"), (6, "  ", "z"), (None, prose(4, 64), "w")]
                 + [(10 + i, prose(10 + i, 1 + 29 * i), "w" if i % 2 else None) for i in range(40)], "event_id bigint, title string, source_name string")
    mixed, slots = mixing.mix_articles(rows)
    capsys.readouterr()
    mixed.explain()
    plan = capsys.readouterr().out
    assert plan.count("BroadcastExchange") == 1 and "REPARTITION_BY_NUM" in plan  # the sources
    passes = {}
    for r in slots.collect():
        passes.setdefault((r["source_name"], r["block"]), []).append(r["pass"])
    start = {(r["event_id"], r["source_name"], r["text_key"]): r["start"] for r in mixing.laid_out(rows).collect()}
    got = mixed.collect()
    assert len(got) == rows.count()
    for r in got:
        at, n = start[r["event_id"], r["source_name"], r["text_key"]], mixing.BLOCK_WORDS
        want = [(p, max(b * n - at, 0), min(b * n + n - at, r["size"])) for b in range(at // n, (at + r["size"] - 1) // n + 1) for p in passes.get((r["source_name"], b), [])] if r["size"] else []
        assert [tuple(x) for x in r["parts"]] == sorted(want) and r["taken"] == sum(hi - lo for _, lo, hi in want)
