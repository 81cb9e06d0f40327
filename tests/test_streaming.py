"""Folds over tables and streams: however a stream is cut, it gives what the table gives, and what a plain loop gives."""

import datetime
import math
import os
import random
import shutil
import sys
import time

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import functions as F

from voxframe.operators.folds import fold_in_order
from voxframe.streaming.folding import fold_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests


def streamed(spark, tmp_path, rows, schema, build, cuts=3, seed=0, event="ts", clock=None):
    """Runs ``build(stream)`` over rows dealt into ``cuts`` micro-batches, then a row of the far future."""
    rng = random.Random(seed)
    place = tmp_path / f"in-{seed}-{cuts}"
    edges = sorted(rng.sample(range(1, len(rows)), cuts - 1)) if cuts > 1 else []
    parts = [rows[a:b] for a, b in zip([0, *edges], [*edges, len(rows)], strict=True)]
    for k, part in enumerate([*parts, *([clock, clock] if clock else [])]):
        part = part if isinstance(part, list) else [part]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{place}/part-{k:03d}")
    stage, files = place / "all", []
    stage.mkdir()
    for k, folder in enumerate(sorted(place.glob("part-*"))):
        for file in folder.glob("*.parquet"):
            target = stage / f"{k:03d}.parquet"
            shutil.copy(file, target)
            stamp = time.time() - 1000 + k
            os.utime(target, (stamp, stamp))
            files.append(target)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(stage))
    name = f"out_{seed}_{cuts}_{abs(hash(str(tmp_path))) % 10**8}"
    query = (
        build(source).writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(place / "checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.table(name)


def values(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=str) if not order else [tuple(r) for r in df.orderBy(*order).collect()]


# The diarizer -------------------------------------------------------------------------------------------------------

SMALL = dict(chunk=12, queue=14, cache=40, period=12, stride=2)


def speaker_model():
    """A stand-in whose word on a frame depends on the frame, on the cache and on the queue."""

    def model(cache, queue, chunk, used):
        made = chunk.reshape(-1, 2, chunk.shape[1]).mean(axis=1)
        parts = [a for a in (cache, queue, made) if len(a)]
        every = np.concatenate(parts)
        lean = 0.1 * np.sin(sum(a.sum() for a in parts[:-1]) if len(parts) > 1 else 0.0)
        p = 1 / (1 + np.exp(-4 * (every[:, :4] + lean)))
        return np.where(np.abs(every[:, 4:5]) > 0.9, 0.01, p), made

    return model


def plain_diarizer(vectors, z):
    """The rule step by step, in lists: no state but local names, the whole recording at hand."""
    model, cache, cache_p, queue, out = speaker_model(), [], None, [], []
    quiet, n_quiet = [0.0] * len(vectors[0]), 0
    size = z["chunk"] * z["stride"]
    for a in range(0, len(vectors), size):
        part = vectors[a : a + size]
        chunk = np.array(part + [[0.0] * len(vectors[0])] * (size - len(part)))
        p, made = model(np.array(cache), np.array(queue), chunk, len(part))
        p, made, new = p.tolist(), made.tolist(), math.ceil(len(part) / z["stride"])
        before, waiting = len(cache), len(queue)
        out += p[before + waiting : before + waiting + new]
        queue, queue_p = queue + made[:new], p[before : before + waiting + new]
        if len(queue) <= z["queue"]:
            continue
        n = min(max(z["period"], max(new - z["queue"], 0) + waiting), len(queue))
        gone, gone_p, queue = queue[:n], queue_p[:n], queue[n:]
        for e, q in zip(gone, gone_p, strict=True):
            if sum(q) < 0.2:
                quiet = [(x * n_quiet + y) / (n_quiet + 1) for x, y in zip(quiet, e, strict=True)]
                n_quiet += 1
        cache = cache + gone
        if cache_p is not None:
            cache_p = cache_p + gone_p
        if len(cache) <= z["cache"]:
            continue
        if cache_p is None:
            cache_p = p[:before] + gone_p
        places, frames = z["cache"] // 4 - 3, len(cache)
        score = []
        for q in cache_p:
            f = [max(x, 0.25) for x in q]
            total = sum(math.log(max(1 - x, 0.25)) for x in f)
            score.append([math.log(x) - math.log(max(1 - x, 0.25)) + total - math.log(0.5) for x in f])
        for s in range(4):
            many = sum(row[s] > 0 for row in score) >= int(places * 0.5)
            for t in range(frames):
                if cache_p[t][s] <= 0.5 or (score[t][s] <= 0 and many):
                    score[t][s] = -math.inf
            for share, scale in ((0.75, 2.0), (1.5, 1.0)):
                for t in sorted(range(frames), key=lambda t: -score[t][s])[: int(places * share)]:  # noqa: B023
                    score[t][s] -= scale * math.log(0.5)
        cells = [(s * (frames + 3) + t, score[t][s] if t < frames else math.inf) for s in range(4) for t in range(frames + 3)]
        best = sorted(cells, key=lambda c: -c[1])[: z["cache"]]
        slots = sorted(10**9 if x == -math.inf else i for i, x in best)
        frame = [None if i == 10**9 or i % (frames + 3) >= frames else i % (frames + 3) for i in slots]
        cache, cache_p = [quiet if t is None else cache[t] for t in frame], [[0.0] * 4 if t is None else cache_p[t] for t in frame]
    return out


def recording(seed, n):
    rng = np.random.default_rng(seed)
    speaker = np.repeat(rng.integers(0, 5, n // 7 + 1), 7)[:n]
    vectors = rng.normal(0, 0.3, (n, 6)) - 0.5
    for k, s in enumerate(speaker):
        vectors[k, s % 5] += 1.6 if s < 4 else 2.5
    return vectors.round(3).tolist()


MEDIA = "media_id long, i long, ts timestamp, vector array<double>"


def test_streaming_diarizer_equals_a_plain_loop(spark, tmp_path):
    from voxframe.operators.speakercache import CacheSizes, StreamingDiarizer

    start = datetime.datetime(2026, 1, 1)
    recordings = {1: recording(1, 331), 2: recording(2, 700), 3: recording(3, 5)}
    rows = [(m, i, start + datetime.timedelta(milliseconds=10 * i), v) for m, r in recordings.items() for i, v in enumerate(r)]
    want = [(m, k, p) for m, r in recordings.items() for k, p in enumerate(plain_diarizer(r, SMALL))]
    fold = StreamingDiarizer(speaker_model, CacheSizes(**SMALL))
    table = spark.createDataFrame(rows, MEDIA).repartition(3)

    def same(got):
        assert [r[:2] for r in got] == [r[:2] for r in want]
        assert np.allclose([r[2] for r in got], [r[2] for r in want])

    same(values(fold_in_order(table, ["media_id"], ["i"], fold, "ts"), "media_id", "frame"))
    rng = random.Random(9)
    rows.sort(key=lambda r: (r[2] + datetime.timedelta(milliseconds=rng.randrange(300)), r[0]))  # by time, a little mixed
    clock = (99, 0, start + datetime.timedelta(hours=1), [0.0] * 6)
    for cuts in (1, 5):
        made = streamed(spark, tmp_path, rows, MEDIA, lambda s: fold_stream(s, ["media_id"], ["i"], fold, "ts", "1 second"), cuts, cuts, clock=clock)
        same(values(made.where("media_id < 99"), "media_id", "frame"))


def test_cache_slots_of_table_and_state_agree(spark):
    from voxframe.operators import diarize
    from voxframe.operators.speakercache import CacheSizes, best_frames, cell_scores

    rng = np.random.default_rng(5)
    for n, sizes in ((60, CacheSizes(cache=40)), (300, CacheSizes()), (9, CacheSizes(cache=40))):
        p = np.where(rng.random((n, 4)) < 0.3, rng.random((n, 4)), rng.random((n, 4)) * 0.4).round(4)
        rows = [(1, t, s, float(p[t, s])) for t in range(n) for s in range(4)]
        cells = spark.createDataFrame(rows, "media_id long, frame long, speaker_id int, p double")
        places = sizes.cache // 4 - 3
        scored = diarize.disable_low(diarize.log_odds(cells), enough=int(places * 0.5))
        scored = diarize.boost(scored, ((int(places * 0.75), 2.0), (int(places * 1.5), 1.0)))
        got = [-1 if r.disabled else r.frame for r in diarize.cache_frames(scored, sizes.cache).orderBy("slot").collect()]
        assert got == best_frames(cell_scores(p, sizes), sizes).tolist()
        assert -1 in got


def test_cache_slots_by_hand(spark):
    from voxframe.operators import diarize

    low = float("-inf")
    cells = spark.createDataFrame([(1, 0, 0, low), (1, 1, 0, 2.0), (1, 2, 0, low), (1, 3, 0, 1.0)], "media_id long, frame long, speaker_id int, score double")
    got = diarize.cache_frames(cells, 4, silent=0).orderBy("slot").collect()
    assert [(r.slot, r.frame, r.disabled) for r in got] == [(0, 1, False), (1, 3, False), (2, None, True), (3, None, True)]
    got = diarize.cache_frames(cells, 4).orderBy("slot").collect()
    assert [(r.slot, r.frame, r.disabled) for r in got] == [(0, 1, False), (1, None, True), (2, None, True), (3, None, True)]


def test_gathered_slots(spark):
    from voxframe.operators import diarize

    slots = spark.createDataFrame([(1, 0, 5, False), (1, 1, None, True)], "media_id long, slot int, frame long, disabled boolean")
    frames = spark.createDataFrame([(1, 5, [1.0, 2.0]), (1, 6, [3.0, 4.0])], "media_id long, frame long, vector array<double>")
    p = spark.createDataFrame([(1, 5, 0, 0.9), (1, 6, 0, 0.1), (1, 6, 1, 0.05)], "media_id long, frame long, speaker_id int, p double")
    got = diarize.gather(slots, frames, diarize.silence_mean(frames, p)).orderBy("slot").collect()
    assert [r.vector for r in got] == [[1.0, 2.0], [3.0, 4.0]]


# Utterances and keys ------------------------------------------------------------------------------------------------

T0 = datetime.datetime(2026, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def mixed(rows, rng, by, spread):
    """Rows by time, each up to ``spread`` seconds too late."""
    return sorted(rows, key=lambda r: (by(r) + rng.random() * spread, str(r)))


def test_utterances_of_table_and_stream_agree(spark, tmp_path):
    from voxframe.operators.session import continue_text, end_of, fold_utterances
    from voxframe.streaming.streams import continue_utterances

    rng = random.Random(3)
    texts = ["Je vois le.", "Chat noir,", "Puis rien!", "Enfin", "deux\nlignes", "Seul...", "", "euh oui", ", et donc", "Le"]
    rows, now = [], 0.0
    for seq in range(120):
        now += rng.choice([1, 5, 29.5, 30, 30.001, 31, 90])
        rows.append((seq % 3, seq, at(now), "fr", rng.choice(texts)))
    words, schema = {"fr": frozenset({"le"})}, "user_id long, seq long, ts timestamp, lang string, text string"
    want, ends = [], {}
    for user, seq, ts, lang, text in rows:  # the rule, row by row
        end, last = ends.get(user, (None, None))
        if last is not None and (ts - last).total_seconds() > 30:
            end = None
        shown, back = continue_text(end, text, lang, words["fr"], ("euh",))
        if text.strip():
            end, last = end_of(shown, lang, words["fr"])[1], ts
        ends[user] = end, last
        want.append((user, seq, shown, back, str(end) if end else None))
    want.sort(key=str)
    assert values(fold_utterances(spark.createDataFrame(rows, schema).repartition(4), words, ("euh",), ttl=30)) == want
    dealt = mixed(rows, rng, lambda r: (r[2] - T0).total_seconds(), 5)
    clock = (9, 999, at(1e6), "fr", "x")
    got = streamed(spark, tmp_path, dealt, schema, lambda s: continue_utterances(s, words, ("euh",), 30, "6 seconds"), 5, clock=clock)
    assert values(got.where("user_id < 9")) == want


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    from voxframe.streaming.streams import continue_utterances

    rows = [(1, 0, at(0), "fr", "Je vois,"), (1, 1, at(100), "fr", "Plus tard"), (1, 2, at(200), "fr", "Encore"), (1, 3, at(1), "fr", "Trop tard")]
    schema = "user_id long, seq long, ts timestamp, lang string, text string"
    got = streamed(spark, tmp_path, rows, schema, lambda s: continue_utterances(s, {}, (), 30, "5 seconds"), 4, clock=(9, 9, at(1e6), "fr", "x"))
    assert [r[1] for r in values(got.where("user_id < 9"))] == [0, 1, 2]


def test_keys_of_table_and_stream_agree(spark, tmp_path):
    from voxframe.operators.session import KeyState, debounce_keys, key_event
    from voxframe.streaming.streams import push_to_talk

    rng = random.Random(4)
    rows, now = [], 1_000_000.0
    for _ in range(300):
        now += rng.choice([20, 100, 149, 150, 300, 499, 500, 2999, 3000, 12_000, 40_000])
        rows.append((rng.randrange(3), now, rng.choice([0, 0, 1, 1, 2])))
    state, want = {}, []
    for user, ms, value in rows:
        want.append((user, ms, value, key_event(state.setdefault(user, KeyState()), ms, value)))
    want.sort(key=str)
    assert {w[3] for w in want} == {"start", "stop", "cancel", "ignore"}
    schema = "user_id long, ms double, value int"
    assert values(debounce_keys(spark.createDataFrame(rows, schema).repartition(4))) == want
    dealt = mixed(rows, rng, lambda r: r[1], 3000)
    got = streamed(spark, tmp_path, dealt, schema, lambda s: push_to_talk(s, late="4 seconds"), 4, clock=(9, 1e10, 0))
    assert values(got.where("user_id < 9")) == want


# Frames, levels, recognisers ----------------------------------------------------------------------------------------


def signal(seed, n):
    rng = np.random.default_rng(seed)
    t = np.arange(n) / 16000
    loud = np.where((t * 3).astype(int) % 3 == 2, 0.4, 0.01)
    return loud * np.sin(2 * np.pi * (200 + 300 * (t * 2 % 1)) * t) + rng.normal(0, 0.002, n)


def blocks(media, x, seed, longest=4000, seconds=0.0):
    rng, out, k = random.Random(seed), [], 0
    while k < len(x):
        size = rng.randrange(0, longest)
        part = x[k : k + size]
        out.append((media, len(out), at(seconds + (k + len(part)) / 16000 + 1e-3 * len(out)), part.tolist()))
        k += len(part)
    return out


BLOCKS = "media_id long, seq long, ts timestamp, samples array<double>"


def test_frames_of_a_signal_in_pieces_are_those_of_the_whole():
    from voxframe.functions.signal import hann, mel_filters
    from voxframe.operators.listening import MelFrames

    x = signal(1, 9000)
    x[77], x[500] = np.nan, np.inf
    for centred in (True, False):
        mel = MelFrames(n_mels=20, centred=centred)
        whole = mel.whole(x)
        assert len(whole) == (len(x) + (512 if centred else 0) - 400) // 160 + 1
        clean = np.where(np.isfinite(x), x, 0.0)
        y = np.pad(np.r_[clean[0], clean[1:] - 0.97 * clean[:-1]], 256 if centred else 0)
        for k in (0, 3, len(whole) - 1):  # the transform by its definition
            frame = y[k * 160 : k * 160 + 400] * hann(400)
            power = [abs(sum(v * np.exp(-2j * np.pi * f * i / 512) for i, v in enumerate(frame))) ** 2 for f in range(257)]
            assert np.allclose(whole[k], np.log(mel_filters(20, 512) @ power + 2.0**-24))
        for seed in range(10):
            rng, state, got, k = random.Random(seed), mel.start(), [], 0
            while k < len(x):
                size = rng.randrange(0, 700)
                got.append(mel.push(state, x[k : k + size]))
                k += size
            assert np.allclose(np.concatenate([*got, mel.finish(state)]), whole)
    assert MelFrames(centred=False).whole(np.zeros(399)).shape == (0, 128)


def chunk_model():
    def model(chunk, used, memory):
        """Tokens of a running sum of the features, so that look-back, memory and borders count."""
        seen = (memory or 0) + 1
        total = chunk[: 9 + used].sum()
        return [(int(abs(total)) % 97, 0), (seen, used - 1)], seen

    return model


def test_chunked_recogniser_does_not_see_how_blocks_are_cut(spark, tmp_path):
    from voxframe.operators.listening import ChunkedRecogniser, MelFrames
    from voxframe.streaming.streams import stream_chunks

    signals = {1: signal(5, 50_000), 2: signal(6, 8960), 3: signal(7, 300)}
    want = []
    for media, x in signals.items():  # the whole recording at hand
        mel, model, memory, pos = MelFrames().whole(x), chunk_model(), None, 0
        for a in range(0, len(mel), 56):
            chunk = np.zeros((65, 128))
            back, new = mel[max(0, a - 9) : a], mel[a : a + 56]
            chunk[9 - len(back) : 9], chunk[9 : 9 + len(new)] = back, new
            tokens, memory = model(chunk, len(new), memory)
            for i, t in tokens:
                want.append((media, pos, i, a + t))
                pos += 1
    want.sort(key=str)
    for seed in (1, 2):
        rows = [r for m, x in signals.items() for r in blocks(m, x, seed + m, 6000 * seed)]
        fold = ChunkedRecogniser(chunk_model)
        assert values(fold_in_order(spark.createDataFrame(rows, BLOCKS).repartition(3), ["media_id"], ["seq"], fold, "ts")) == want
    dealt = mixed(rows, random.Random(1), lambda r: (r[2] - T0).total_seconds(), 0.5)
    got = streamed(spark, tmp_path, dealt, BLOCKS, lambda s: stream_chunks(s, chunk_model, "1 second"), 4, clock=(9, 0, at(1e6), [0.0]))
    assert values(got.where("media_id < 9")) == want


def level_loop(x, bands=8):
    """The meter by the definition, chunk after chunk."""
    edges = [int(80 * 50 ** (i / bands) * 640 / 16000) for i in range(bands + 1)]
    gain = [math.sqrt(50 ** ((i + 0.5) / bands)) for i in range(bands)]
    keep = [0.35 + (0.05 - 0.35) * i / (bands - 1) for i in range(bands)]
    first, floor, shown, out = [], None, [0.0] * bands, []
    for k in range(len(x) // 640):
        size = np.abs(np.fft.rfft(x[k * 640 : k * 640 + 640] * np.hanning(640)))
        level = []
        for b in range(bands):
            lo = max(1, edges[b])
            part = size[lo : max(lo + 1, edges[b + 1])]
            level.append((math.sqrt(np.mean(part**2)) * 0.6 + max(part) * 0.4) * gain[b])
        if floor is None:
            first.append(level)
            out.append([0.0] * bands)
            if len(first) == 25:
                floor = [1.2 * sum(f[b] for f in first) / 25 for b in range(bands)]
            continue
        ratio = [max(0, v - f) / max(f, 1e-6) for v, f in zip(level, floor, strict=True)]
        shown = [s * a + min(1, math.log1p(r) / math.log1p(20)) * (1 - a) for s, a, r in zip(shown, keep, ratio, strict=True)]
        out.append(shown)
    return out


def test_level_meter_equals_a_loop(spark, tmp_path):
    from voxframe.operators.listening import LevelMeter
    from voxframe.streaming.streams import level_meter

    signals = {1: signal(8, 40_000), 2: signal(9, 640 * 26 + 639), 3: signal(9, 100)}
    want = [(m, k, v) for m, x in signals.items() for k, v in enumerate(level_loop(x))]
    assert max(max(w[2]) for w in want) > 0.3
    rows = [r for m, x in signals.items() for r in blocks(m, x, m)]

    def same(got):
        assert [r[:2] for r in got] == [r[:2] for r in want]
        assert np.allclose([r[2] for r in got], [r[2] for r in want])

    same(values(fold_in_order(spark.createDataFrame(rows, BLOCKS).repartition(3), ["media_id"], ["seq"], LevelMeter()), "media_id", "chunk"))
    got = streamed(spark, tmp_path, sorted(rows, key=lambda r: r[2]), BLOCKS, lambda s: level_meter(s, "1 second"), 4, clock=(9, 0, at(1e6), [0.0]))
    same(values(got.where("media_id < 9"), "media_id", "chunk"))


def utterance_model():
    class Model:
        """Says which third of the frames is loudest; 5 is the end mark, said after three tokens."""

        def encode(self, features, cache):
            return features.reshape(5, -1).mean(axis=1, keepdims=True), (cache or 0) + 1

        def step(self, state, last, frame):
            said = (state or 0) + 1
            scores = np.full(8, -np.inf)
            scores[7] = np.nan
            if said % 2 == 0:
                scores[0] = 1.0
            elif said > 5:
                scores[5] = 1.0
            else:
                scores[1 + int(abs(frame[0] * 10)) % 3] = 1.0
            return scores, said

        def piece(self, token):
            return f"<{token}>"

    return Model()


def test_utterance_recogniser_warms_up_and_begins_anew(spark, tmp_path):
    from voxframe.operators.listening import UtteranceRecogniser
    from voxframe.streaming.streams import stream_recogniser

    x = signal(3, 30_000)
    rows = [(1, k, at((k + 1) * 0.16), x[k * 2560 : (k + 1) * 2560].tolist()) for k in range(11)]
    fold = UtteranceRecogniser(utterance_model, blank=6, end=5, size=8)
    got = values(fold_in_order(spark.createDataFrame(rows, BLOCKS), ["media_id"], ["seq"], fold, "ts"), "seq")
    assert [r[1] for r in got][0] == 6  # a second is 16,000 samples: the seventh block
    made = streamed(spark, tmp_path, rows, BLOCKS, lambda s: stream_recogniser(s, utterance_model, 6, 5, "1 second", size=8), 3, clock=(9, 0, at(1e6), [0.0]))
    assert values(made.where("media_id < 9"), "seq") == got


# Chunks that overlap ------------------------------------------------------------------------------------------------


def test_each_token_is_owned_once(spark, tmp_path):
    from voxframe.operators.intervals import merge_chunks
    from voxframe.streaming.streams import owned_chunks, owned_tokens

    rng = random.Random(2)
    schema = "media_id long, chunk long, n_chunks long, pos long, chunk_start double, start double, end double, text string, ts timestamp"
    rows = []
    for media, duration in ((1, 400.0), (2, 50.0), (3, 230.0)):
        n = max(math.ceil(duration / 105), 1)
        tokens = sorted(round(rng.uniform(0, duration - 1), 3) for _ in range(200))
        for c in range(n):
            inside = [t for t in tokens if c * 105 <= t < min(c * 105 + 120, duration) - 0.5]
            rows += [(media, c, n, k, c * 105.0, t - c * 105, t - c * 105 + 0.4, f"w{t}", at(t)) for k, t in enumerate(inside)]
    want = values(merge_chunks(spark.createDataFrame(rows, schema)))
    assert len({(w[0], w[4]) for w in want}) == len(want)
    rows += rng.sample(rows, 60)  # sent again
    dealt = mixed(rows, rng, lambda r: (r[-1] - T0).total_seconds(), 20)
    assert values(streamed(spark, tmp_path, dealt, schema, owned_tokens, 4, seed=1)) == want
    plain = [(m, at(t)) for m in (1, 2) for t in (rng.uniform(0, 1000) for _ in range(300))]
    plain.sort(key=lambda r: r[1])
    got = values(streamed(spark, tmp_path, plain, "media_id long, ts timestamp", owned_chunks, 4, seed=2, clock=(9, at(1e6))).where("media_id < 9"))
    assert sum(r[3] for r in got) == 600  # in two windows each by place, in one by ownership


# Recognition in context ---------------------------------------------------------------------------------------------


def spoken_model():
    def model(samples):
        """Each second of samples is a word named by its level; a level of 99 is a failure, 0 is silence."""
        words = []
        for k in range(0, len(samples) - 7, 8):
            level = int(round(max(samples[k : k + 8])))
            if level == 99:
                raise ValueError("no model")
            if level:
                words.append((f"w{level}", k / 8.0, k / 8.0 + 1))
        return words

    return model


def test_recognition_in_context(spark, tmp_path):
    from voxframe.operators.listening import ContextRecogniser, cut_out
    from voxframe.streaming.streams import recognise_in_context

    def said(*levels):
        return [float(v) for v in levels for _ in range(8)]

    rows = [
        (1, 0, at(0), said(1, 2, 3)), (1, 1, at(10), said(4, 5)), (1, 2, at(41), said(6)), (1, 3, at(60), said(99)),
        (1, 4, at(62), said(7, 8, 9)), (1, 5, at(65), said(0, 0)), (1, 6, at(70), said(2)), (2, 0, at(5), said(3)),
    ]
    schema = "user_id long, seq long, ts timestamp, samples array<double>"
    options = {"rate": 8}
    df = spark.createDataFrame(rows, schema)

    def run(mode):
        fold = ContextRecogniser(spoken_model, mode, **options)
        return {r[:2]: r[2:] for r in values(fold_in_order(df, ["user_id"], ["seq"], fold, "ts"))}

    times = run("times")
    assert times[1, 0] == ("w1 w2 w3", False, False) and times[2, 0] == ("w3", False, False)
    assert times[1, 1] == ("w4 w5", True, False)  # behind its context, without it
    assert times[1, 2] == ("w6", False, False)  # 31 s later: expired
    assert times[1, 3] == ("", False, True) and times[1, 4] == ("w7 w8 w9", True, False)
    assert times[1, 5] == ("", True, False) and times[1, 6][0] == "w2"
    dual = run("dual")
    assert dual[1, 1] == ("w4 w5", True, False) and dual[1, 5][0] == "" and dual[1, 6][0] == "w2"
    assert not any(v[1] for v in run("none").values())
    got = streamed(
        spark, tmp_path, sorted(rows, key=lambda r: r[2]), schema,
        lambda s: recognise_in_context(s, spoken_model, "times", "2 seconds", **options), 3, clock=(9, 0, at(1e6), said(1)),
    )
    assert {r[:2]: r[2:] for r in values(got.where("user_id < 9"))} == times
    assert cut_out("Bonjour à tous", "hier soir. Bonjour, a tous") == "Bonjour, a tous"  # one mismatch
    assert cut_out("un deux trois", "rien de tel ici") == "un deux trois"
    assert cut_out("un deux", "x un deux trois quatre cinq six") == "un deux"  # far too long


# Decoding side by side ----------------------------------------------------------------------------------------------


def step_model():
    class Model:
        """The state counts tokens; frames decide with it."""

        def begin(self, lanes):
            return [np.zeros(lanes), np.ones((lanes, 2))]

        def step(self, memory, last, frames):
            count, other = memory
            mixed_up = (frames[:, 0] * 7 + count * 3 + last + other.sum(axis=1)).astype(int)
            scores = np.full((len(frames), 9), -np.inf)
            scores[np.arange(len(frames)), mixed_up % 9] = 1.0
            scores[:, 8] = np.where(mixed_up % 9 == 8, 1.0, np.nan)
            return scores, (mixed_up // 9) % 3, [count + 1, other + 1]

    return Model()


def attention_model():
    class Model:
        def _scores(self, sums):
            scores = -np.abs(np.arange(12)[None] - (sums % 12)[:, None]).astype(float)
            return scores

        def first(self, prompts, encoded):
            sums = np.array([sum(p) + int(e.sum()) for p, e in zip(prompts, encoded, strict=True)])
            return self._scores(sums), [sums, np.arange(len(sums))]

        def next(self, memory, last):
            sums = memory[0] * 5 + last + 1
            return self._scores(sums), [sums, memory[1]]

    return Model()


def test_lanes_decode_as_one_by_one(spark):
    from voxframe.operators import decoding
    from voxframe.operators.ports import greedy_transducer

    rng = np.random.default_rng(6)
    frames = [rng.integers(0, 50, (n, 1)).astype(float) for n in (0, 1, 30, 7, 64, 30, 2)]
    model = step_model()

    def alone(f, eou):
        memory, last, t, out = model.begin(1), -1, 0, []
        while t < len(f):
            said, step = 0, 0
            for _ in range(5 if eou else 10):
                scores, duration, after = model.step(memory, np.array([last]), f[t : t + 1])
                token = int(decoding.finite_argmax(scores)[0])
                if eou and token == 5:
                    out.append((5, t))
                    memory, last = model.begin(1), -1
                    break
                if token == 8 or (eou and (token == 0 or token >= 7)):
                    step = 0 if eou else int(duration[0])
                    break
                out.append((token, t))
                memory, last, said = after, token, said + 1
                if not eou and duration[0] > 0:
                    step = int(duration[0])
                    break
            t += max(step, 1)
        return out

    assert decoding.transducer_lanes(frames, model, blank=8) == [alone(f, False) for f in frames]
    assert decoding.utterance_lanes(frames, model, blank=8, end=5, size=7) == [alone(f, True) for f in frames]
    prompts = [[k + 1, 2] for k in range(len(frames))]
    lanes = decoding.attention_lanes(prompts, frames, attention_model(), end=3, most=40)
    assert lanes == [decoding.attention_lanes([p], [f], attention_model(), end=3, most=40)[0] for p, f in zip(prompts, frames, strict=True)]
    assert len({len(x) for x in lanes}) > 1 and max(map(len, lanes)) <= 40
    rows = [(k, prompts[k], f.tolist()) for k, f in enumerate(frames)]
    df = spark.createDataFrame(rows, "media_id long, prompt array<int>, vectors array<array<double>>").repartition(2)
    got = values(decoding.decode_transducer(df, step_model, 8, limit=40))
    assert got == sorted(((k, p, *x) for k, f in enumerate(frames) for p, x in enumerate(alone(f, False))), key=str)
    got = values(decoding.decode_utterances(df, step_model, 8, 5, size=7))
    assert got == sorted(((k, p, *x) for k, f in enumerate(frames) for p, x in enumerate(alone(f, True))), key=str)
    got = values(decoding.decode_attention(df, attention_model, 3, 40))
    assert got == sorted(((k, p, *x) for k, tokens in enumerate(lanes) for p, x in enumerate(tokens)), key=str)

    def one_frame():
        def step(state, vector):
            memory, last = state or (model.begin(1), -1)
            scores, duration, after = model.step(memory, np.array([last]), np.array([vector]))
            token = int(decoding.finite_argmax(scores)[0])
            return token, int(duration[0]), (after, token)

        return step

    cells = spark.createDataFrame([(k, t, v.tolist()) for k, f in enumerate(frames) for t, v in enumerate(f)], "media_id long, frame long, vector array<double>")
    got = values(greedy_transducer(cells.repartition(3), one_frame, 8))
    assert got == sorted(((k, p, *x) for k, f in enumerate(frames) for p, x in enumerate(alone(f, False))), key=str)
    assert decoding.finite_argmax(np.array([[np.nan, -np.inf], [np.inf, 2.0]])).tolist() == [0, 1]


def test_segments_corrected_in_turn(spark):
    from voxframe.operators.ports import correct_in_turn

    def factory():
        def model(text, before):
            if text == "bad":
                raise ValueError
            return "" if text == "same" else f"{text}|{before[:6]}"

        return model

    rows = [(m, k, t) for m in (1, 2) for k, t in enumerate(["a", "same", "bad", "b"])]
    got = values(correct_in_turn(spark.createDataFrame(rows, "media_id long, seg_no long, text string").repartition(3), factory), "media_id", "seg_no")
    assert [r[3] for r in got] == ["a|", "same", "bad", "b|bad"] * 2


# Replies and progressive text ---------------------------------------------------------------------------------------


def test_replies_cut_anywhere_read_the_same(spark, tmp_path):
    import json

    from voxframe.operators.replies import BLOCK_EVENTS, CHAT_EVENTS, NDJSON, StreamedReplies, streamed_replies

    words = [" Été ", "chez", " nous ☀", "\n", "fin  "]
    chat = [json.dumps({"choices": [{"delta": {"content": w}}]}, ensure_ascii=False) for w in words]
    blocks = [json.dumps({"type": "content_block_delta", "delta": {"text": w}}) for w in words]
    sent = {
        1: (NDJSON, "\n".join([*(json.dumps({"response": w}) for w in words), "no json", "[1]", '{"done": true}', '{"response": "late"}'])),
        2: (CHAT_EVENTS, "\n\n".join(["event: x", *(f"data: {c}" for c in chat), 'data: {"choices": []}', "data: [DONE]", f"data: {chat[0]}"])),
        3: (BLOCK_EVENTS, "\n".join(["event: y", *(f"data: {b}" for b in blocks), 'data: {"type": "message_stop"}', f"data: {blocks[0]}"])),
        4: (BLOCK_EVENTS, f'data: {blocks[0]}\ndata: {{"type": "error", "error": {{"message": "too much"}}}}\ndata: {blocks[1]}'),
        5: (CHAT_EVENTS, "data: [DONE]"), 6: (NDJSON, json.dumps({"response": "no line end"})),
    }
    whole = "".join(words).strip()
    want = {1: (whole, None), 2: (whole, None), 3: (whole, None), 4: (None, "too much"), 5: (None, "empty reply"), 6: ("no line end", None)}
    schema = "reply_id long, seq long, kind string, data binary"
    for size in (1, 7, 10_000):
        rows = []
        for k, (kind, text) in sent.items():
            data = text.encode()
            rows += [(k, i, kind, data[i : i + size]) for i in range(0, len(data), size)]
        got = {r.reply_id: (r.text, r.error) for r in streamed_replies(spark.createDataFrame(rows, schema).repartition(3)).collect()}
        assert got == want
    timed = [(k, i, at(i / 100), kind, bytes(d)) for k, i, kind, d in sorted(rows, key=lambda r: r[1])]
    fold = StreamedReplies()
    fold.idle = 1000.0
    made = streamed(
        spark, tmp_path, timed, "reply_id long, seq long, ts timestamp, kind string, data binary",
        lambda s: fold_stream(s, ["reply_id"], ["seq"], fold, "ts", "1 second"), 3, clock=(9, 0, at(1e6), NDJSON, b""),
    )
    texts = {}
    for r in made.where("reply_id < 9").orderBy("reply_id", F.col("seq").asc_nulls_last()).collect():
        texts[r.reply_id] = texts.get(r.reply_id, "") + (r.text or "")
    assert {k: texts[k].strip() for k in (1, 2, 3, 6)} == {k: want[k][0] for k in (1, 2, 3, 6)}


def test_progressive_text(spark):
    from voxframe.operators.replies import progressive_text

    pieces = ["<s>", "▁", "▁Bon", "jour", "▁", "<0xE2>", "<0x98>", "<0x80>", "<unk>", "[SEP]", "é!", "</s>", "<0xC3>"]
    rows = [(1, k, p, float(k), k + 1.0) for k, p in enumerate(pieces)]
    got = values(progressive_text(spark.createDataFrame(rows, "media_id long, pos long, piece string, start double, end double")), "pos")
    assert [(r[1], r[2]) for r in got] == [(2, " Bon"), (3, "jour"), (4, " "), (7, "☀"), (8, "<unk>"), (10, "é!")]
