"""Tokens, chat windows and personal data."""
from __future__ import annotations

import hashlib
import random
import re

import public_tokenizers
import pytest
import tiktoken

from auditframe.llm import bpe, chat, pii

RAW = bpe.rank_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RAW), special_tokens={})


def test_codec_equals_library(library, texts):
    codec, rng = bpe.Codec(bpe.read_ranks(RAW)), random.Random(3)
    signs = "aeinrst éüß的語ありпривет🙂  \u0085\x1c\n\t 0123½'\"!?.,-_()<|>"
    cases = [*texts.values(), "", "x" * 5000, "  \n\n  a", *["".join(rng.choices(signs, k=rng.randint(1, 60))) for _ in range(1500)]]
    for text in cases:
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text)
        assert codec.decode(ids) == text


def test_transducer_equals_merges_on_any_bytes(library):
    ranks, rng = bpe.read_ranks(RAW), random.Random(4)
    machine, tokens = bpe.Transducer(ranks, states=500), list(ranks)
    for _ in range(1500):
        piece = b"".join(rng.choices(tokens, k=5))
        assert list(machine.encode(piece)) == library._encode_single_piece(piece)


def test_stream_holds_back_unfinished_characters():
    stream, data = bpe.Utf8Stream(), "aé語🙂z".encode()
    assert "".join(stream.feed(data[k : k + 1]) for k in range(len(data))) + stream.end() == "aé語🙂z"
    assert bpe.Utf8Stream().feed(b"a\xff\xffb") == "a��b"


def test_rows_of_edge_cases(edge, empty, library):
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest_rows(edge, RAW).collect()), key=repr)
    want = []
    for r in edge.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.digest_rows(empty, RAW).count() == 0
    back = bpe.decode_rows(bpe.encode_rows(edge, RAW), RAW)
    assert sorted((r.text for r in back.collect())) == sorted(r.text or "" for r in edge.collect())


TURNS = "conv_id long, turn long, role string, text string, pos string, window int"


def test_windows_hold_every_turn_once_and_repeat_history(make):
    rng = random.Random(1)
    rows = []
    for conv in range(6):
        if conv % 2:
            rows.append((conv, 0, "system", "be kind <|im_end|>", "p", 1))
        for turn in range(1, 40 * conv + 3):
            rows.append((conv, turn, rng.choice(["user", "assistant", "as%0Asis\ntant"]), " ".join(["<|im_start|>", "<\\|x", "w"][k % 3] for k in range(rng.randint(0, 60))), "p", 1))
    windows = chat.format_windows(make(TURNS, *rows), budget=300, history=60)
    read = {}
    for r in chat.read_turns(windows).orderBy("conv_id", "window").collect():
        turns, loss = read.setdefault(r.conv_id, ([], []))
        turns += [(t.role, t.text) for t in r.turns]
        loss.append(r.loss)
    for conv in range(6):
        own = [(r[2], r[3]) for r in sorted(r for r in rows if r[0] == conv)]
        assert read[conv][0] == own
        assert "".join(read[conv][1]) == "".join(t for role, t in own if role == "assistant")
    longest = max(len(r[3].split()) for r in rows) + 5
    late = windows.where("window > 0").collect()
    assert all(r.tokens <= 300 + longest for r in windows.collect()) and any(r.repeated > 1 for r in late)
    assert all(r.text.startswith("<|im_start|>system\nbe kind <\\|im_end|><|im_end|>") for r in late if r.conv_id % 2)


def test_windows_of_edge_cases(make):
    rows = [(None, None, None, None, None, None), (None, 1, "assistant", "hi", None, None), (1, 1, "user", "same", "p", 1), (1, 1, "user", "same", "p", 1), (2, 0, "system", "alone", "p", 1), (3, 0, "assistant", "w " * 9000, "p", 1)]
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_turns(chat.format_windows(make(TURNS, *rows))).collect()}
    assert got == {None: [("", ""), ("assistant", "hi")], 1: [("user", "same")] * 2, 2: [("system", "alone")], 3: [("assistant", "w " * 9000)]}
    assert chat.format_windows(make(TURNS)).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def fine(kind, hit):
        d = re.sub("[^0-9]", "", hit)
        if kind == "ip":
            return all(int(p) <= 255 for p in hit.split("."))
        if kind == "card":
            return 14 <= len(d) <= 19 and sum((int(c) * 2 - 9 * (int(c) > 4) if k % 2 else int(c)) for k, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 10 <= len(d) <= 15

    return sorted((m.start(), n, m.end()) for n, kind in enumerate(BASE) for m in re.finditer(BASE[kind], text or "") if fine(kind, m.group()))


def test_base_spans_equal_brute_force(make, documents, texts):
    rng = random.Random(9)
    alphabet = ["a", "@", ".", "b.c", "x@y.zz", "1", "22", "255", "256", "+", "+1 ", "-", " ", "4111 1111 1111 1111", "(", ")", "é", "🙂", "0", "_", "%"]
    rows = [(k, "".join(rng.choices(alphabet, k=rng.randint(1, 40)))) for k in range(1500)]
    rows += [(5000, "1" * 40_000), (5001, "a" * 60_000 + "@"), (5002, None), (5003, ""), (5004, "1." * 3000), (5005, "a@b.co_x@d.ee@f.gg")]
    spans = pii.select_spans(pii.candidates(make("doc_id long, text string", *rows)), None)
    got = {r.doc_id: [tuple(s) for s in r.base] for r in spans.collect()}
    assert got == {d: brute_spans(t) for d, t in rows}
    whole = {r.doc_id: [tuple(s) for s in r.base] for r in pii.find_spans(documents).collect()}
    assert whole == {d: brute_spans(t) for d, t in texts.items()}


def test_trees_add_numbers_without_the_plus_and_leave_dates(make):
    rng, rows = random.Random(2), []
    for k in range(900):
        number = f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        rows.append((k, f"please call {'+1 ' if k < 800 else ''}{number} today"))
    rows += [(1000 + k, f"on {rng.randint(10, 28)}-{rng.randint(10, 12)}-{rng.randint(1990, 2020)} and item {rng.randint(10, 99)}-{rng.randint(100, 999)}-{rng.randint(1000, 9999)} of list") for k in range(600)]
    got = {r.doc_id: ([tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in pii.find_spans(make("doc_id long, text string", *rows)).collect()}
    assert all(set(base) <= set(spans) for base, spans in got.values())
    assert not any(spans for d, (_, spans) in got.items() if d >= 1000)


def test_trees_add_wide_forms_although_most_documents_have_them(make):
    rng, rows = random.Random(4), []
    for k in range(600):
        number, host = f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}", f"host{rng.randint(1, 99)}"
        # Half of the mail addresses and numbers are written in wide forms: by their labels they were negatives once.
        rows.append((k, f"please call {'+1 ' if k % 2 else ''}{number} today"))
        rows.append((1000 + k, f"write to anna{k}{'@' if k % 2 else ' [at] '}{host}{'.' if k % 2 else ' [dot] '}org today"))
        rows.append((2000 + k, f"a sum of +{k % 9 + 1}.{rng.randint(10, 99)} percent"))
    got = {r.doc_id: ([tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in pii.find_spans(make("doc_id long, text string", *rows)).collect()}
    texts = dict(rows)
    found = {d: [texts[d][s:e] for s, _, e in spans if (s, _, e) not in base] for d, (base, spans) in got.items()}
    assert all(found[d] == [texts[d][9 if d >= 1000 else 12 : -6]] for d in texts if d < 2000 and d % 2 == 0)
    assert not any(found[d] for d in texts if d % 2 or d >= 2000)


def test_edge_cases_and_redaction(make, edge, empty):
    spans = pii.find_spans(edge)
    assert spans.count() == edge.count() and {r.doc_id for r in spans.where("size(spans) > 0").collect()} == {10}
    assert pii.find_spans(empty).count() == 0
    docs = make("doc_id long, text string, _spans string", (1, "é a.b@c.de, +1 (212) 555-0100 x", "s"), (2, None, "s"))
    got = {r.doc_id: r.text for r in pii.redact(docs, pii.find_spans(docs)).collect()}
    assert got == {1: "é [email], [phone] x", 2: ""}
