"""Sound, decks, speech, jobs and the stream of sidecars."""

import csv
import io
import json
import ssl
import wave
import zipfile

import numpy as np
import pytest

from cueloom import jobs
from cueloom.errors import DeckParseError, InvalidInput, SynthesisError
from cueloom.operators import insertion, signal
from cueloom.sources import audio, pptx, speech
from cueloom.streaming import sidecars


def noise(seconds, seed=0, rate=8000):
    return np.random.default_rng(seed).normal(0, 0.3, int(seconds * rate)).astype(np.float32)


def test_clip_is_found_away_from_its_prediction():
    clip = noise(6)
    track = np.concatenate([noise(7.25, 1), clip, noise(5, 2)])
    assert signal.find_offset(track, clip[:8000], 6.0) == pytest.approx(7.25, abs=0.001)
    assert signal.find_offset(track[:100], clip, 3.5) == 3.5


def test_stretched_clip_is_measured_at_both_ends():
    clip = noise(60)
    at = np.arange(int(len(clip) * 1.001)) / 1.001
    track = np.concatenate([noise(3, 1), np.interp(at, np.arange(len(clip)), clip).astype(np.float32), noise(4, 2)])
    start, end = signal.measured_bounds(track, clip, 2.0, anchor_s=2.0)
    assert start == pytest.approx(3, abs=0.05) and end == pytest.approx(63.06, abs=0.05)


def test_words_are_checked(spark):
    clip = noise(20)
    track = np.concatenate([noise(2, 1), clip, noise(2, 2)])
    words = spark.createDataFrame([(1, 1, 0, "a", 0.0, 0.2, 2.1, 1.0), (1, 1, 1, "b", 5.0, 0.3, 2.1, 1.0), (1, 1, 2, "c", 19.9, 0.1, 2.1, 1.0)], "deck_id long, slide_num int, ev_idx int, text string, offset_s double, duration_s double, start_s double, scale double")
    clips = spark.createDataFrame([(1, 1, clip.tolist())], "deck_id long, slide_num int, samples array<float>")
    tracks = spark.createDataFrame([(1, track.tolist())], "deck_id long, samples array<float>")
    (r,) = signal.check_words(words, clips, tracks).collect()  # the first is at the start, the last has too little sound
    assert r.text == "b" and r.measured_s == pytest.approx(7.0, abs=0.001) and r.naive_delta == pytest.approx(-0.1, abs=0.001)


def wav(x, rate=8000, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.repeat(x, channels) * 20_000).astype("<i2").tobytes())
    return out.getvalue()


def test_wav(spark, tmp_path):
    assert len(audio.decode_wav(wav(noise(1, rate=16_000), 16_000, 2))) == 8000
    assert audio.decode_wav(b"no sound") is None
    (tmp_path / "a.wav").write_bytes(wav(noise(0.5)))
    (tmp_path / "b.wav").write_bytes(b"broken")
    assert {r.path[-5:]: r.audio_ms for r in audio.read_wav(spark, str(tmp_path)).collect()} == {"a.wav": 500, "b.wav": None}


def deck(slides):
    """A deck of (shape texts, note paragraphs or None)."""
    head = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shape = lambda paragraphs, kind="": f"<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:txBody>{''.join(f'<a:p><a:r><a:t>{t}</a:t></a:r></a:p>' for t in paragraphs)}</p:txBody></p:sp>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        ids = "".join(f'<p:sldId id="{i}" r:id="rId{i}"/>' for i in range(len(slides)))
        z.writestr("ppt/presentation.xml", f"<p:presentation {head}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>")
        links = "".join(f'<Relationship Id="rId{i}" Type="{rel}/slide" Target="slides/slide{i}.xml"/>' for i in range(len(slides)))
        z.writestr("ppt/_rels/presentation.xml.rels", f"<Relationships>{links}</Relationships>")
        for i, (shapes, notes) in enumerate(slides):
            z.writestr(f"ppt/slides/slide{i}.xml", f"<p:sld {head}>{''.join(shape([s]) for s in shapes)}</p:sld>")
            if notes is not None:
                z.writestr(f"ppt/slides/_rels/slide{i}.xml.rels", f'<Relationships><Relationship Id="r1" Type="{rel}/notesSlide" Target="../notesSlides/n{i}.xml"/></Relationships>')
                z.writestr(f"ppt/notesSlides/n{i}.xml", f"<p:notes {head}>{shape(notes, '<p:ph type=\"body\"/>')}</p:notes>")
    return out.getvalue()


def test_decks(spark, tmp_path):
    content = deck([(["Click to add title", "Real title"], ["  One. ", "", "Two."]), ([], None), (["T"], [" "])])
    (tmp_path / "a.pptx").write_bytes(content)
    rows = pptx.read(spark, str(tmp_path / "a.pptx")).orderBy("slide_num").collect()
    assert [(r.slide_num, r.title, r.notes) for r in rows] == [(1, "Real title", "One.\n\nTwo."), (2, None, None), (3, "T", None)]
    with pytest.raises(DeckParseError):
        pptx.parse(b"not a deck")
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(InvalidInput):
        pptx.read(spark, str(tmp_path / "a.txt"))


@pytest.mark.parametrize(("error", "again"), [(ConnectionError(), True), (TimeoutError(), True), (OSError(), True), (FileNotFoundError(), False), (ssl.SSLCertVerificationError(), False), (TypeError(), False), (ValueError(), False), (KeyError(), False)])
def test_retries(error, again):
    assert speech.retryable(error) == again
    tries = []

    def fails(text, voice):
        tries.append(text)
        raise error

    with pytest.raises(SynthesisError):
        speech.spoken("x", "v", fails, 2, 0)
    assert len(tries) == (3 if again else 1)
    tries.clear()
    with pytest.raises(SynthesisError):
        speech.spoken("x", "v", fails, -1, 0)
    assert len(tries) == 1


def test_speech_of_a_table(spark):
    slides = spark.createDataFrame([(1, 1, "Hi."), (1, 2, " "), (1, 3, None)], "deck_id long, slide_num int, notes string")
    assert [(r.slide_num, r.ev_idx, r.text, r.offset_ms) for r in speech.generate(slides).collect()] == [(1, 0, "H", 0), (1, 1, "i", 200)]


def test_insertion(spark):
    sound = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 9, "c")], "deck_id long, slide_num int, audio_file string")
    files = spark.createDataFrame([(1, "a"), (1, "c")], "deck_id long, audio_file string")
    slides = spark.createDataFrame([(1, 1), (1, 2)], "deck_id long, slide_num int")
    r = insertion.results(insertion.plan(sound, files, slides)).first()
    assert r.inserted_slides == [1] and [(x.slide_num, x.reason) for x in r.skipped_slides] == [(2, "audio file not found"), (9, "slide not found")]


@pytest.fixture
def files(tmp_path):
    notes = "The first sentence is here. The second one follows it."
    slides = [{"slide_num": 1, "title": "t", "notes": notes}, {"slide_num": 2, "title": "s", "notes": None}]
    events = [{"text": t, "offset_seconds": ms / 1000, "duration_seconds": d / 1000} for t, ms, d in audio.synthesize(notes, "v")]
    (tmp_path / "slides.json").write_text(json.dumps({"slides": slides}))
    (tmp_path / "manifest.json").write_text(json.dumps({"voice": "v", "slides": [{"slide_num": 1, "audio_file": "a.wav", "word_boundaries_file": "a.json"}]}))
    (tmp_path / "a.json").write_text(json.dumps(events))
    (tmp_path / "a.wav").write_bytes(wav(noise(len(notes) * 0.2)))
    (tmp_path / "bounds.json").write_text('{"1": [1000, 12800], "2": [13000, null]}')
    return tmp_path


def run(spark, files, *args):
    return jobs.main([a.replace("@", f"{files}/") for a in args], spark)


def test_subtitle_job(spark, files):
    deck_args = ("--slides-json", "@slides.json", "--manifest", "@manifest.json")
    assert run(spark, files, "subtitles", *deck_args, "--output", "@out.srt") == 0
    first = (files / "out.srt").read_text()
    assert first.startswith("1\n00:00:00,000 --> ") and "second one" in first
    assert run(spark, files, "subtitles", *deck_args, "--bounds", "@bounds.json", "--output", "@m.srt") == 0
    assert (files / "m.srt").read_text().startswith("1\n00:00:01,000 --> ")
    assert run(spark, files, "subtitles", *deck_args, "--strict", "--output", "@x.srt") == 1
    assert run(spark, files, "subtitles", "--slides-json", "@slides.json", "--manifest", "@none.json", "--output", "@e.srt") == 0
    assert (files / "e.srt").read_text() == ""
    assert run(spark, files, "gaps", *deck_args) == 0
    assert run(spark, files, "gaps", *deck_args, "--slides", "7") == 1
    (files / "a.json").write_text("{broken")
    assert run(spark, files, "subtitles", *deck_args, "--output", "@b.srt") == 0
    assert (files / "b.srt").read_text() == ""  # recorded and passed over


def test_jobs_with_a_track(spark, files, caplog):
    """A track of five silent seconds before the slide's sound: located there, dumped, read again, and verified word by word."""
    deck_args = ("--slides-json", "@slides.json", "--manifest", "@manifest.json")
    sound = audio.decode_wav((files / "a.wav").read_bytes())
    (files / "track.wav").write_bytes(wav([0.0] * (3 * audio.RATE) + sound.tolist() + [0.0] * (9 * audio.RATE)))
    assert run(spark, files, "locate", *deck_args, "--track", "@track.wav", "--output", "@dump.json") == 0
    dump = json.loads((files / "dump.json").read_text())
    assert dump["bounds"]["1"]["start"] == pytest.approx(3.0, abs=0.01) and list(dump["bounds"]) == ["1"]
    assert dump["params"]["global_scale_correction"] == 1.0 and dump["warnings"] == []
    assert run(spark, files, "subtitles", *deck_args, "--track", "@track.wav", "--output", "@t.srt") == 0
    assert run(spark, files, "subtitles", *deck_args, "--bounds", "@dump.json", "--output", "@d.srt") == 0
    assert (files / "t.srt").read_text() == (files / "d.srt").read_text()
    assert (files / "t.srt").read_text().startswith("1\n00:00:03,000 --> ")
    # What is no sound leaves the predicted timeline.
    (files / "bad.wav").write_text("no sound")
    for name in ("@bad.wav", "@none.wav"):
        assert run(spark, files, "subtitles", *deck_args, "--track", name, "--output", "@p.srt") == 0
        assert (files / "p.srt").read_text().startswith("1\n00:00:00,000 --> ")
        assert run(spark, files, "locate", *deck_args, "--track", name, "--output", "@x.json") == 1
    assert run(spark, files, "verify", *deck_args, "--track", "@track.wav", "--csv", "@w.csv") == 0
    raw = (files / "w.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfslide_num,text,word_offset_seconds,") and raw.endswith(b"\r\n")
    rows = list(csv.DictReader(io.StringIO(raw.decode("utf-8-sig"))))
    assert len(rows) == 2 and len(rows[0]) == 9 and all(abs(float(r["naive_delta_seconds"])) < 0.02 for r in rows)
    (files / "c.srt").write_text("1\n00:00:00,000 --> 00:00:14,000\nhello\n")
    assert run(spark, files, "split", "--srt", "@c.srt", "--bounds", "@bounds.json", "--track", "@track.wav", "--output", "@parts") == 0
    assert run(spark, files, "split", "--srt", "@c.srt", "--bounds", "@bounds.json", "--output", "@parts") == 1


def test_decks_without_a_track_keep_the_predicted_timeline(spark):
    from cueloom.plans import captions

    sound = [float(x) for x in np.random.default_rng(5).normal(size=4 * audio.RATE)]
    slides = spark.createDataFrame([(d, 1, "t", "Some words here", None, 4000) for d in (1, 2)], "deck_id long, slide_num int, title string, notes string, subtitle_text string, audio_ms long")
    entries = spark.createDataFrame([(d, 1, "a") for d in (1, 2)], "deck_id long, slide_num int, audio_file string")
    events = spark.createDataFrame([(d, 1, 0, "Some", 100, 200) for d in (1, 2)], "deck_id long, slide_num int, ev_idx int, text string, offset_ms long, duration_ms long")
    clips = spark.createDataFrame([(d, 1, sound) for d in (1, 2)], "deck_id long, slide_num int, samples array<float>")
    tracks = spark.createDataFrame([(1, [0.0] * (2 * audio.RATE) + sound)], "deck_id long, samples array<float>")
    timed, told = captions.subtitles_from_sound(slides, entries, events, clips, tracks)
    assert {r.deck_id: r.start_ms for r in timed.collect()} == {1: 2100, 2: 100}
    got = {(r.deck_id, r.code, r.message.split(")")[0]) for r in told.collect()}
    assert (2, "no_track", "(true-start locate") in got and (2, "unmeasured") in {x[:2] for x in got}


def test_lines_and_logs(spark, files, capsys):
    (files / "n.txt").write_text("\ufeffOne. Two.\nThree", encoding="utf-8")
    assert run(spark, files, "lines", "--file", "@n.txt") == 0
    assert capsys.readouterr().out == "One. Two\nThree\n"
    assert run(spark, files, "lines", "--text", "Only this.") == 0 and run(spark, files, "lines") == 0
    assert capsys.readouterr().out.startswith("Only this\n")
    assert jobs.main(["--log-file", f"{files}/x.log", "gaps", "--slides-json", f"{files}/none.json", "--manifest", f"{files}/m.json"], spark) == 1
    assert "there is no file" in (files / "x.log").read_text()


def test_other_jobs(spark, files, capsys):
    (files / "obs.json").write_text('{"1": 1.0012, "2": 13.0156, "8": 3}')
    assert run(spark, files, "calibrate", "--observations", "@obs.json", "--bounds", "@bounds.json") == 0
    report = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert report["suggested_scale"] == pytest.approx(1.0012, abs=1e-4) and report["missing_slides"] == [8]
    (files / "obs.json").write_text("{}")
    assert run(spark, files, "calibrate", "--observations", "@obs.json", "--bounds", "@bounds.json") == 1
    (files / "c.srt").write_text("1\n00:00:00,000 --> 00:00:14,000\nhello\n")
    assert run(spark, files, "split", "--srt", "@c.srt", "--bounds", "@bounds.json", "--total-ms", "26000", "--output", "@parts") == 0
    assert (files / "parts/part_02.srt").read_text() == "1\n00:00:00,000 --> 00:00:01,000\nhello\n"
    assert run(spark, files, "split", "--srt", "@c.srt", "--bounds", "@bounds.json", "--total-ms", "26000", "--after", "5", "--output", "@parts") == 1
    (files / "o.txt").write_text("Same words here")
    (files / "p.txt").write_text("Same words, here.")
    assert run(spark, files, "compare", "--original", "@o.txt", "--processed", "@p.txt") == 0
    (files / "p.txt").write_text("Other words here")
    assert run(spark, files, "compare", "--original", "@o.txt", "--processed", "@p.txt") == 1
    assert run(spark, files, "set-text", "--slides-json", "@slides.json", "--slide", "2", "--text", "shown") == 0
    assert json.loads((files / "slides.json").read_text())["slides"][1]["subtitle_text"] == "shown"
    assert run(spark, files, "set-text", "--slides-json", "@slides.json", "--slide", "5", "--text", "x") == 1


def test_sidecar_stream(spark, tmp_path):
    durations = spark.createDataFrame([(7, 1, 1000), (7, 2, 9000), (8, 1, 500)], "deck_id long, slide_num int, audio_ms long")
    place = lambda d, s: tmp_path / f"in/deck_id={d}/slide_{s:03d}.wordboundaries.json"
    put = lambda d, s, x: (place(d, s).parent.mkdir(parents=True, exist_ok=True), place(d, s).write_text(x))
    event = lambda at: json.dumps([{"text": "a", "offset_seconds": at, "duration_seconds": 0.5}])
    put(7, 1, event(0.4))
    put(7, 2, event(1.0))
    go = lambda: sidecars.audit(sidecars.read(spark, str(tmp_path / "in")), durations, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    go()
    put(8, 1, "{broken")
    go()  # goes on where it stopped
    slides = spark.read.parquet(str(tmp_path / "out/slides")).orderBy("slide_num").collect()
    assert [(r.slide_num, r.gap_ms, r.flagged) for r in slides] == [(1, 100, False), (2, 7500, True)]
    assert [(r.deck_id, r.code) for r in spark.read.parquet(str(tmp_path / "out/warnings")).collect()] == [(8, "unreadable_events")]
