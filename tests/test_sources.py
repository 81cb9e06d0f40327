"""Files read and written, settings, whole plans, and small functions that no query reaches, on fixtures."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.functions import signal, text
from voxframe.operators import diarize, render, textrules
from voxframe.plans import transcripts
from voxframe.sources import audio, config, sinks, vocab, wire


def wav(samples, rate=16000, channels=1, code=1, bits=16, extra=b"", extended=False):
    data = b"".join(struct.pack("<f" if code == 3 else "<h", s) for s in samples)
    form = struct.pack("<HHIIHH", 0xFFFE if extended else code, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    if extended:
        form += struct.pack("<HHIH", 22, bits, 0, code) + b"\0" * 14
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + extra + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_wave_files(spark, tmp_path):
    files = {
        "a": wav([0, 16384, -32768]), "b": wav([0.5, -0.25], 44100, 2, 3, 32), "c": b"no wave", "d": wav([1], extended=True),
        "e": wav([1, 2], extra=b"LIST" + struct.pack("<I", 3) + b"abc\0"), "f": wav([1], bits=8), "g": wav([1])[:20], "h": wav([8], rate=8000),
    }
    for name, data in files.items():
        (tmp_path / f"{name}.wav").write_bytes(data)

    def read(**options):
        rows = audio.read_audio(spark, str(tmp_path), **options).collect()
        return {r.path.split("/")[-1][0]: r for r in rows}

    got = read()
    assert got["a"].samples == [0.0, 0.5, -1.0] and (got["a"].sample_rate, got["a"].channels, got["a"].status) == (16000, 1, "ok")
    assert got["b"].samples == [0.5, -0.25] and (got["b"].sample_rate, got["b"].channels) == (44100, 2)
    assert {k for k, r in got.items() if r.status == "error"} == {"c", "f", "g"}
    assert got["c"].error == "not a RIFF wave file" and got["c"].samples is None and len(got["e"].samples) == 2
    assert {k for k, r in read(strict_mono=True).items() if r.status == "ok"} == {"a", "d", "e"}
    mono_float = tmp_path / "i.wav"
    mono_float.write_bytes(wav([0.5], code=3, bits=32))
    assert read(strict_mono=True)["i"].status == "ok" and "16-bit" in read(strict=True)["i"].error
    (tmp_path / "list.txt").write_text(" one.wav \n\n\ntwo.wav\n")
    assert [r.path for r in audio.read_paths(spark, str(tmp_path / "list.txt")).collect()] == ["one.wav", "two.wav"]


def test_model_files(spark, tmp_path):
    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    pieces = ["<unk>", "▁the", "é" * 20, ""]
    model = b"".join(field(1, field(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", -1.5) + bytes([3 << 3, 1])) for p in pieces)
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.model").write_bytes(model + field(2, b"other"))
    got = vocab.read_sentencepiece(spark, str(tmp_path / "m")).orderBy("id").collect()
    assert [r.piece for r in got] == pieces and [r.id for r in got] == [0, 1, 2, 3]
    (tmp_path / "m" / "b.bin").write_bytes(b"\0" * (3 << 20))
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "c.bin").write_bytes(b"\0" * 10)
    rows = {r.location.split("/")[-1]: (r.n_files, r.size_mb) for r in vocab.inventory(spark, str(tmp_path)).collect()}
    assert rows == {"m": (2, 3), "n": (1, 0)}
    special = spark.createDataFrame([(p,) for p in ("<|en|>", "<unk>", "<pad>", "<s>", "a<|x|>")], "p string")
    kinds = special.select(vocab.is_special(F.col("p"), "attention"), vocab.is_special(F.col("p"))).collect()
    assert [tuple(r) for r in kinds] == [(True, True), (True, False), (True, True), (False, True), (False, False)]


def test_settings(spark):
    system = spark.createDataFrame([("fr", "a"), ("*", "b")], "lang string, word string")
    none = system.where("false")
    user = spark.createDataFrame([("en", "c")], "lang string, word string")
    assert config.replace_rows(system, none).count() == 2
    assert [tuple(r) for r in config.replace_rows(system, user).collect()] == [("en", "c")]
    assert config.for_language(system, "en").count() == 1 and config.for_language(system, None).count() == 2
    lines = ["# x", "A=1", " B = 'two' ", 'C="3', "A=4", "", "no pair", "D='\"x\"'"]
    rows = spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")
    assert dict(map(tuple, wire.parse_key_values(rows).collect())) == {"A": "4", "B": "two", "C": '"3', "D": '"x"'}
    nodes = [
        {"id": 1, "info": {"props": {"node.name": "mic", "media.class": "Audio/Source", "node.description": "My Headset"}}},
        {"id": 2, "info": {"props": {"node.name": "out", "media.class": "Audio/Sink"}}}, {"id": 3, "info": {"props": {"media.class": "Audio/Sink"}}},
        {"id": 4, "info": {"props": {"node.name": "v", "media.class": "Video/Source"}}},
        {"id": 5, "info": {"props": {"node.name": "cam", "media.class": "Audio/Source", "node.description": "Webcam"}}},
    ]
    listing = spark.createDataFrame([(json.dumps(nodes),)], "json string")
    got = [tuple(r) for r in config.audio_nodes(listing).collect()]
    assert got == [("mic", "audio-headset", "My Headset"), ("out", "audio-speakers", "out"), ("cam", "camera-web", "Webcam")]


def test_alignment_of_words(spark):
    cases = [
        ("a b c", "a b c d e", 3, "d e"), ("a b c", "a x c d", 2, "d"), ("a b c d e", "a x c y e f", 3, "a x c y e f"), ("", "a b", 0, "a b"),
        ("a b", "c d", 0, "c d"), ("a b c d e f g h i j", "a b c d x f g y i j k", 8, "k"), ("a b", "a", 1, "a"),
    ]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, buffer string, combined string, n int, want string")
    words = {c: F.filter(F.split(c, " "), lambda w: w != "") for c in ("buffer", "combined")}
    got = df.select("k", "n", "want", text.aligned(words["buffer"], words["combined"]).alias("same"), F.array_join(text.strip_prefix(words["buffer"], words["combined"]), " ").alias("left"))
    for r in got.orderBy("k").collect():
        assert (r.same, r.left) == (r.n, r.want), r


SEGMENTS = "media_id long, seg_no long, speaker string, display string, start double, end double, text string"


def test_texts_and_lines_on_disk(spark, tmp_path):
    rows = [(1, 0, "0", "Ann", 0.0, 1.5, "Hello"), (1, 1, "1", "Bob", 2.0, 3661.25, "Yes."), (2, 0, "0", "Ann", 0.0, 1.0, "Alone")]
    segments = spark.createDataFrame(rows, SEGMENTS)
    sinks.write_texts(render.srt_text(segments), str(tmp_path / "srt"))
    got = "".join(p.read_text() for p in sorted((tmp_path / "srt" / "media_id=1").glob("*.txt")))
    assert got == "1\n00:00:00,000 --> 00:00:01,500\n[Ann] Hello\n\n2\n00:00:02,000 --> 01:01:01,250\n[Bob] Yes.\n\n"
    sinks.write_json_lines(segments.select("media_id", "text"), str(tmp_path / "json"))
    lines = [json.loads(x) for p in (tmp_path / "json").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted(x["text"] for x in lines) == ["Alone", "Hello", "Yes."]
    whole = json.loads(render.json_text(segments).where("media_id = 1").first().text)
    assert whole[1] == {"start": 2.0, "end": 3661.25, "speaker_id": "1", "speaker": "Bob", "text": "Yes."}
    runs = spark.createDataFrame([(1, 61.0, 2.04)], "media_id long, transcribe_seconds double, translate_seconds double")
    summary = {r.media_id: r.summary for r in render.run_summary(segments, runs).collect()}
    assert summary == {1: "2 speakers — 61:01 — transcribed in 1:01 — translated in 2.0s", 2: "1 speaker — 1.0s"}
    assert [r.text for r in render.text_from(segments, 2.5).collect()] == ["Yes."]


def test_typing_commands(spark):
    df = spark.createDataFrame([(1, "a\n\nb\tc\x01"), (2, ""), (3, "\n")], "k long, text string")
    got = [tuple(r)[0:1] + tuple(r)[2:] for r in render.typing_commands(df, "k").orderBy("k", "n").collect()]
    keys = [(1, "type", "a"), (1, "enter", None), (1, "enter", None), (1, "type", "b"), (1, "tab", None), (1, "type", "c"), (1, "ctrl+j", None)]
    assert got == [*keys, (3, "enter", None)]


def test_frames_between_the_thresholds_toggle(spark):
    p = [0.1, 0.5, 0.5, 0.5, 0.7, 0.5, 0.3, 0.5, 0.9]
    rows = spark.createDataFrame([(m, 0, k, x) for m in (1, 2) for k, x in enumerate(p)], "media_id long, speaker_id int, frame int, p double")
    t = diarize.Thresholds(onset=0.4, offset=0.6)
    on, want = False, []
    for x in p:  # at most one change a frame
        on = x >= t.offset if on else x >= t.onset
        want.append(on)
    for m in (1, 2):
        assert [r.active for r in diarize.active_frames(rows, t).where(F.col("media_id") == m).orderBy("frame").collect()] == want
    assert want[1:4] == [True, False, True]


def test_log_mel_against_its_definition(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.1, 1000)
    got = signal.log_mel(spark.createDataFrame([(1, x.tolist()), (2, [])], "media_id long, samples array<double>"), n_mels=12).orderBy("media_id", "frame").collect()
    y = np.pad(np.r_[x[0], x[1:] - 0.97 * x[:-1]], 256)
    mine = [r.mel for r in got if r.media_id == 1]
    assert len(mine) == (len(y) - 512) // 160 + 1
    bank, window = signal.mel_filters(12, 512), np.zeros(512)
    window[:400] = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(400) / 399)
    turn = np.exp(-2j * np.pi * np.outer(np.arange(257), np.arange(512)) / 512)
    for k, mel in enumerate(mine):
        power = np.abs(turn @ (y[k * 160 : k * 160 + 512] * window)) ** 2
        assert np.allclose(mel, np.log(bank @ power + 2.0**-24))
    assert np.allclose(bank.sum(axis=1)[3:] > 0, True) and np.isclose(signal.hann(5).tolist(), [0, 0.5, 1, 0.5, 0]).all()


def test_rule_trace_and_gates(spark):
    df = spark.createDataFrame([("euh hello  world. how\tare you", "en"), (" \n", "en"), ("", "fr")], "text string, lang string")
    chain = textrules.TextChain(dictionary={"en": {"world": "planet"}})
    made = chain.apply(df).collect()
    assert made[1].text == " " and made[2].text == ""  # blank texts pass
    seen = chain.trace(df).first()
    assert [r.label for r in seen.trace] == [label for label, _ in chain.steps()]
    assert seen.trace[0].before == "euh hello  world. how\\tare you"
    assert all(a.after == b.before for a, b in zip(seen.trace, seen.trace[1:], strict=False))
    assert seen.trace[-1].after.replace("\\t", "\t") == made[0].text and "planet" in made[0].text and "How" in made[0].text
    off = textrules.TextChain(textrules.Gates(*[False] * 11))
    assert [label for label, _ in off.steps()] == ["scrub"]
    assert textrules.lint([textrules.Rule("a(", ""), textrules.Rule("aд", ""), textrules.Rule("ok", "")])[0].startswith("rule 0")
    assert len(textrules.lint([textrules.Rule("a(", ""), textrules.Rule("aд", ""), textrules.Rule("ok", "")])) == 2
    words = spark.createDataFrame([("the cat of. The", "en")], "t string, l string")
    assert words.select(textrules.fix_continuation(F.col("t"), ["of"])).first()[0] == "the cat of the"


def test_whole_plans(spark):
    tokens = [("▁Hello", 0.0, 0.4), ("▁hello", 0.4, 0.6), ("▁world", 0.6, 1.0), (".", 1.0, 1.0), ("▁Good", 5.0, 5.4), ("▁day", 5.4, 5.8), ("!", 5.8, 5.9)]
    rows = spark.createDataFrame([(1, k, *t) for k, t in enumerate(tokens)], "media_id long, pos long, text string, start double, end double")
    speakers = spark.createDataFrame([(1, 0, "0", 0.0, 2.0), (1, 1, "1", 4.0, 6.0)], "media_id long, ord long, speaker string, start double, end double")
    made = transcripts.diarized_transcript(rows, speakers).orderBy("start").collect()
    assert [(r.speaker, r.text) for r in made] == [("0", "Hello world."), ("1", "Good day!")]
    chunks = [(1, 0, 2, 0.0, 100.0, 101.0, "x"), (1, 0, 2, 0.0, 118.0, 119.0, "late"), (1, 1, 2, 105.0, 13.0, 14.0, "late"), (1, 1, 2, 105.0, 50.0, 51.0, "y")]
    cut = spark.createDataFrame(chunks, "media_id long, chunk long, n_chunks long, chunk_start double, start double, end double, text string")
    wide = spark.createDataFrame([(1, 0, "0", 0.0, 400.0)], "media_id long, ord long, speaker string, start double, end double")
    got = transcripts.chunked_transcript(cut, wide).orderBy("start").collect()
    assert [(r.text, r.start, r.speaker) for r in got] == [("x", 100.0, "0"), ("late", 118.0, "0"), ("y", 155.0, "0")]
    segments = spark.createDataFrame([(1, 0, "0", "A", 0.0, 1.0, "so  good. yes", "en")], SEGMENTS + ", lang string")
    assert transcripts.rebuilt_lines(segments).first().line.endswith("0: So good. Yes")

    def translate(df):
        return df.withColumn("translated", F.when(F.col("text").contains("Fail"), F.lit(None).cast("string")).otherwise(F.concat(F.lit(" "), F.upper("text"))))

    said = spark.createDataFrame([("one two three four", "en"), ("fail two three four", "en")], "text string, lang string")
    chain = textrules.TextChain()
    assert [r.text for r in transcripts.dictated_text(said, chain).collect()] == ["One two three four", "Fail two three four"]
    once = [r.text for r in transcripts.dictated_text(said, chain, translate).collect()]
    assert once == [" ONE TWO THREE FOUR", "Fail two three four"]
    twice = transcripts.dictated_text(said, chain, translate, chain, "fr").collect()
    assert [r.text for r in twice] == [" ONE TWO THREE FOUR", "Fail two three four"] and twice[0].lang == "en"


@pytest.mark.parametrize("n", [0, 1])
def test_gates_of_loudness(spark, n):
    rows = spark.createDataFrame([(1, 0.5 * n)], "media_id long, value double")
    assert signal.loud_enough(rows).count() == n
