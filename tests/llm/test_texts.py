import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkprep.llm import bpe, langid, lines, pii

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# lines


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    with_word = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), len(with_word) - len(set(with_word)), len(covered)


def brute_fails(line):
    chars, gaps, low = sum(map(len, WORD.findall(line))), len(line) - sum(map(len, WORD.findall(line))), line.lower()
    breaks, symbols = sum(c in "|»>•" for c in line), sum(c in "#*$%&|<>{}~^=_\\" for c in line)
    if breaks >= 2 and breaks > lines.SEPARATORS * gaps or len(line) <= lines.NAVIGATION_CHARS and re.search(lines.NAVIGATION, low):
        return True
    return symbols > lines.SYMBOL_SHARE * chars or gaps >= lines.OPEN_WORDS and line.rstrip(lines.SPACE)[-1:] not in lines.END or any(p in low for p in lines.BOILERPLATE)


def test_line_rules_against_brute_force(documents, clashing, small, none):
    for docs in (documents, small):
        texts = {(r.doc_id, r.text): r.text or "" for r in docs.collect()}
        want = []
        for (doc_id, _), text in texts.items():
            counts = brute_counts(text)
            stay = [x for x in text.split("\n") if WORD.search(x) and not brute_fails(x)]
            lost = 1.0 if not counts[1] else 1 - sum(len(w) for x in stay for w in WORD.findall(x)) / counts[1]
            failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
            want.append((str(doc_id), *counts, failed, not failed and lost <= lines.LOST))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
        got = {(str(r.doc_id), *[r[n] for n in names]) for r in lines.verdicts(docs).collect()}
        assert got == set(want)
    assert lines.verdicts(none).count() == 0
    kept = lines.clean(clashing)
    assert kept.columns == clashing.columns and kept.count() == lines.verdicts(clashing).where("kept").count()


def test_failing_lines_go_and_the_rest_stays(spark):
    good = "This is a sentence of plain words that says something."
    docs = spark.createDataFrame([(1, f"{good}\nHome | News | About | Login\n{good[::-1]} Yes.\nAll rights reserved.")], "doc_id long, text string")
    assert [r.text for r in lines.clean(docs).collect()] == [f"{good}\n{good[::-1]} Yes."]


# language


def test_languages_on_held_out_documents(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.languages(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out AND n_chars > 40")
    n, right = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 200 and right / n >= 0.98


def test_language_of_odd_texts(clashing, none):
    import zlib

    rows = langid.languages(clashing).collect()
    assert len(rows) == clashing.count()
    texts = {r.doc_id: r.text for r in clashing.collect()}
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert langid.languages(none).count() == 0
    assert {r.lang_pred for r in langid.languages(clashing.withColumn("lang", clashing["lang"].substr(9, 1)).where("false").unionByName(clashing.selectExpr(*[f"null AS {c}" if c == "lang" else c for c in clashing.columns]))).collect()} == {"und"}


def test_kernels_against_sets():
    texts = ["one two three", "zwei und drei", "uno dos tres y más", "a", "two"]
    rows = [(("en", "de", "es")[i % 3], 1, langid.presence(t)) for i, t in enumerate(texts[:3])]
    model = langid.Model(rows)
    sets = [set(langid.presence(t).tolist()) for t in texts]
    known = set().union(*sets[:3])
    got = model._kernels(model._table([langid.presence(t) for t in texts]))
    for i, s in enumerate(sets):
        for j, z in enumerate(sets[:3]):
            assert got[i, j] == pytest.approx(len(s & z) / max(1, len(s & known)) ** 0.5 / len(z) ** 0.5, abs=1e-5)


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = "the quick brown fox und die Straße " * 40
    whole = langid.presence(text)
    monkeypatch.setattr(langid, "PIECE", 50)
    assert np.array_equal(whole, langid.presence(text))


# personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.-+ 0123459()\n_%é", max_size=60))
def test_base_spans_against_the_patterns(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_base_spans_of_documents(small):
    for r in small.collect():
        assert pii.base_spans(r.text or "") == brute_spans(r.text or "")


def test_hostile_texts_take_linear_time():
    import time

    began = time.time()
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "1 " * 100_000):
        pii.find([text], pii.trained())
    assert time.time() - began < 60


def test_field_finds_what_patterns_miss_and_leaves_prose():
    cases = {
        "ring me on (646) 555-0123 please": ["phone"],
        "my box is kate@workhost now": ["email"],
        "use 4000 1111 2222 3334 for it": ["card"],
        "version 3.2 of 2019 has 12 parts, 5% more than 1.9": [],
        "nothing here but words": [],
        "on 2020-05-17 at 11:45 we saw 1,500 birds": [],
    }
    for (text, kinds), (base, more) in zip(cases.items(), pii.find(list(cases), pii.trained())):
        assert [pii.KINDS[k] for _, k, _ in base + more] == kinds, text


def test_plain_lines_need_no_decoding(small):
    field = pii.trained()
    assert field.outside
    plain = [x.split() for r in small.collect() for x in (r.text or "").split("\n") if x.split() and not re.search("[0-9@]", x)]
    assert len(plain) > 100 and not any(labels.any() for labels in field.decode(plain))


def test_viterbi_against_all_labellings():
    from itertools import product

    field = pii.trained()
    for line in ("call (755) 555-9729 now", "a 12 b", "x@y z"):
        words = line.split()
        scores = field.own[field.ids(words)].sum(1)
        best = max(product(range(5), repeat=len(words)), key=lambda y: sum(scores[i, k] for i, k in enumerate(y)) + sum(field.moves[a, b] for a, b in zip(y, y[1:])))
        assert tuple(field.decode([words])[0]) == best


def test_one_long_line_pads_no_others():
    import tracemalloc

    field = pii.trained()
    lines_ = [["7"]] * 3000 + [["a", "12"] * 2500]
    tracemalloc.start()
    got = field.decode(lines_)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000
    alone = [field.decode([x])[0] for x in (lines_[0], lines_[-1])]
    assert np.array_equal(got[0], alone[0]) and np.array_equal(got[-1], alone[1]) and [len(x) for x in got] == [len(x) for x in lines_]


def test_span_digest_and_redaction(clashing, none):
    rows = {r.doc_id: r for r in pii.found_spans(clashing).collect()}
    assert (rows[9].n_email, rows[9].n_ip, rows[9].n_card, rows[9].n_phone) == (1, 1, 1, 1)
    assert rows[3].spans == "" and rows[3].n_email == 0
    out = pii.redact(clashing, n_chars="n_chars")
    assert out.columns == clashing.columns
    texts = {r.doc_id: r for r in out.collect()}
    assert texts[9].text == "write to [EMAIL] or [PHONE] from [IP] with [CARD]" and texts[9].n_chars == len(texts[9].text)
    assert texts[3].text is None and texts[4].text == ""
    assert pii.found_spans(none).count() == 0 and pii.redact(none).count() == 0


# tokens


@pytest.fixture(scope="session")
def coders():
    import public_tokenizers as p
    import tiktoken

    path = p.path(bpe.VOCABULARY)
    return bpe.Coder(path, p.PATTERN), tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def check_ids(coders, texts):
    own, want = coders
    for text in texts:
        ids = [i for block in own.blocks(text) for i in np.frombuffer(block, "<u4").tolist()]
        assert ids == want.encode_ordinary(text)
        assert own.decoder.stream(ids, (0, b"")) == (text, (0, b""))


def test_ids_of_documents(coders, small):
    check_ids(coders, [r.text or "" for r in small.collect()])


def test_ids_of_odd_texts(coders, monkeypatch):
    rng = np.random.default_rng(3)
    tokens = list(coders[0].transducer.merges.tokens.values())
    texts = [b"".join(tokens[i] for i in rng.integers(0, len(tokens), 40)).decode("utf-8", "ignore") for _ in range(300)]
    texts += ["".join(map(chr, rng.integers(32, 0x2FFF, 60))) for _ in range(200)] + ["", "a" * 3000, " " * 500, "\n\n\t x" * 50, "🙂👍" * 40, "ab" * 900]
    check_ids(coders, texts)
    monkeypatch.setattr(bpe, "STATES", 500)  # states and parts start anew, and long texts come in blocks
    monkeypatch.setattr(bpe, "PARTS", 50)
    monkeypatch.setattr(bpe, "BLOCK", 7)
    check_ids(coders, texts[:120])


def test_states_do_not_hold_tokens(coders):
    from itertools import product

    own, want = bpe.Transducer(coders[0].transducer.merges.ranks), coders[1]
    words = [" " + "".join(x) for x in product(["an", "tion", "ouê", "ß", "th", "er", "wh", "keit", "ñ", "ly"], repeat=4)]
    assert all(list(own.encode(word.encode())) == want.encode_ordinary(word) for word in words)
    assert len(own.states) < 800  # 1055 when states held tokens too


def test_long_parts_are_read_by_stretches(coders, monkeypatch):
    parts = ["a" * 700, "ab" * 300, " " * 500, "🙂👍" * 40, "ionsquelettersandthennation" * 20, "語言模型" * 60, "x"]
    for stretch in (1, 3, 16, 100):
        monkeypatch.setattr(bpe, "STRETCH", stretch)
        coders[0].clear()
        check_ids(coders, parts)


def test_cut_characters_alone_are_decoded_by_bytes(coders):
    own, tokens = bpe.Decoder(coders[0].transducer.merges.tokens), coders[0].transducer.merges.tokens
    text = "plain words, then ꙮ and 𒀀 and more plain words " * 5
    ids = coders[1].encode_ordinary(text)
    assert own.stream(ids, (0, b"")) == (text, (0, b""))
    cut = own.known[0, b""]
    assert cut and all(not tokens[i].isascii() for i in cut)
    for at in range(len(ids)):  # a stream goes on where it stopped, inside a character too
        first, state = own.stream(ids[:at], (0, b""))
        rest, state = own.stream(ids[at:], state)
        assert (first + rest, state) == (text, (0, b""))


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=24), st.lists(st.integers(0, 24), max_size=5))
def test_stream_decoding_of_any_bytes(data, cuts):
    tokens = {i: data[a:b] for i, (a, b) in enumerate(zip([0, *sorted(cuts)], [*sorted(cuts), len(data)]))}
    own = bpe.Decoder(tokens)
    text, state = own.stream(sorted(tokens), (0, b""))
    try:
        want = data.decode()
    except UnicodeDecodeError:
        assert "\N{REPLACEMENT CHARACTER}" in text + own.end(state)
    else:
        assert text + own.end(state) == want


def test_token_digest(clashing, none):
    import hashlib

    texts = {r.doc_id: r.text or "" for r in clashing.collect()}
    rows = bpe.encoded(clashing).collect()
    assert len(rows) == clashing.count()
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)
    assert bpe.encoded(none).count() == 0


def test_line_ends_of_other_systems_and_scripts(spark):
    words = "this line has more than thirty words and ends as it should so that no rule of any line takes it from its text whatever white space may follow the last mark of it here now"
    hindi = "यह एक लंबी पंक्ति है " * 9
    texts = [f"{words}.\n{words[::-1]}.", f"{words}.\r\n{words[::-1]}.\r\n", f"{words}.\t\n{words[::-1]}.\u00a0", f"{hindi.strip()} नई।", f"{words}؟"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.lost for r in lines.verdicts(docs).orderBy("doc_id").collect()] == [0.0] * 5
    kept = {r.doc_id: r.kept for r in lines.verdicts(docs.where("doc_id < 3")).collect()}
    assert len(set(kept.values())) == 1
