"""Chat windows: read back whole, escaped reversibly, budgets and masks kept."""

import hashlib
import random

import public_tokenizers

from gramwise.llm import chat
from gramwise.llm.wordpieces import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "conv_id long, turn long, role string, text string, segment int, window string"


def slow(rows):
    by = {}
    for conv, turn, role, text, *_ in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def some_rows():
    rng = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>assistant\n", "<\\|", "<|", "\\", "|", "<", "hello ", "wörld ", "\n", "日本"]
    rows = []
    for conv in range(25):
        for turn in range(rng.randint(1, 60) if conv else 700):
            role = "system" if turn == 0 and conv % 3 == 0 else rng.choice(["user", "assistant"])
            rows.append((conv, turn, role, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30))), 1, "x"))
    rows += [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok", 1, "x"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok", 1, "x")]
    rows += [(90, 1, "assistant", None, 1, "x"), (90, None, None, "no turn", 1, "x"), (90, 1, "assistant", "tie", 1, "x"), (90, 1, "assistant", "tie", 1, "x"), (None, 0, "user", "no id", 1, "x")]
    rows += [(91, 0, "odd\\role\n<|im_end|>", "t", 1, "x"), (92, 0, "assistant", "long " * 50_000, 1, "x"), (93, -5, "user", "below", 1, "x")]
    return rows


def test_escape_is_reversible():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("<|\\a") for _ in range(rng.randint(0, 9)))
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text


def test_windows_hold_every_turn_once(spark):
    rows = some_rows()
    windows = chat.chat_windows(spark.createDataFrame(rows, SCHEMA), PATH, budget=120, history=40, most_history=3, segment_turns=64).persist()
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(windows).collect()}
    assert got == slow(rows)
    tokens = WordTokenizer(PATH)
    last = {}
    for w in sorted(windows.collect(), key=lambda w: (str(w["conv_id"]), w["segment"], w["window"])):
        turns = chat.parse(w["formatted"])
        assert len(turns) == w["n_turns"] and "".join(f"<|im_start|>{chat._header(r)}\n{chat.escape(t)}<|im_end|>\n" for r, t, _, _ in turns) == w["formatted"]
        assert w["n_tokens"] == sum(4 + len(tokens.ids(t)) + len(tokens.ids(r)) for r, t, _, _ in turns)
        assert w["n_tokens"] <= 120 or w["n_turns"] - w["n_repeated"] == 1
        targets = [(a, b) for r, _, a, b in turns[w["n_repeated"] :] if r == "assistant"]
        assert list(zip(w["loss_start"], w["loss_end"], strict=True)) == targets
        if w["segment"] or w["window"]:
            conv = [(r, t) for c, _, r, t, *_ in sorted((x for x in rows if x[0] == w["conv_id"]), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))]
            repeated = [(r, t) for r, t, _, _ in turns[: w["n_repeated"]]]
            if conv[0][0] == "system":
                assert repeated[0] == conv[0]
                repeated = repeated[1:]
            seen = last[w["conv_id"]]
            assert len(repeated) <= 3 and (not repeated or seen[-len(repeated) :] == repeated)
        last.setdefault(w["conv_id"], []).extend((r, t) for r, t, _, _ in turns[w["n_repeated"] :])
    assert any(w["n_repeated"] > 1 for w in windows.collect())


def test_empty_table(spark):
    assert chat.read_back(chat.chat_windows(spark.createDataFrame([], SCHEMA), PATH)).count() == 0


def test_turn_numbers_of_any_size_are_ranked(spark):
    """Epoch milliseconds and sparse numbers behave like 0, 1, 2, ...; only their order counts."""
    rng = random.Random(8)
    texts = ["word " * rng.randint(0, 9) for _ in range(150)]
    who = lambda k: "system" if k == 0 else ("user", "assistant")[k % 2]
    plain = [(1, k, who(k), t, 1, "x") for k, t in enumerate(texts)]
    for spread in (lambda k: 800_000_000_000 + 1000 * k, lambda k: -(10**15) + 10**13 * k, lambda k: 1_000_000 * k):
        windows = {}
        for name, rows in (("plain", plain), ("sparse", [(1, spread(k), *r[2:]) for k, r in enumerate(plain)])):
            out = chat.chat_windows(spark.createDataFrame(rows, SCHEMA), PATH, budget=120, history=40, most_history=3, segment_turns=32)
            windows[name] = sorted(tuple(r) for r in out.collect())
        assert windows["plain"] == windows["sparse"] and len({w[1] for w in windows["plain"]}) == 5


def test_many_rows_of_one_turn_number_across_segments(spark):
    rows = [(1, 0, "system", "s", 1, "x")] + [(1, 5, "user", f"u{k:03}", 1, "x") for k in range(90)] + [(1, 9, "assistant", "a", 1, "x")]
    windows = chat.chat_windows(spark.createDataFrame(rows, SCHEMA), PATH, budget=100, history=40, most_history=3, segment_turns=16).persist()
    assert {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(windows).collect()} == slow(rows)
    last = max(windows.collect(), key=lambda w: (w["segment"], w["window"]))
    assert [t for _, t, _, _ in chat.parse(last["formatted"])] == ["s", "u087", "u088", "u089", "a"]
