"""Timed words to text: matching, gaps, interpolation, clamping; timelines and calibration."""

import pytest
from pyspark.sql import functions as F

from cueloom.errors import InvalidInput
from cueloom.operators import align, calibrate, gaps, intervals, merge, srt, timeline
from cueloom.operators.align import find_span

SEG = "deck_id long, slide_num int, seg_idx int, start int, end int, text string"
MATCH = "deck_id long, slide_num int, ev_idx int, source_start_offset int, source_end_offset int, offset_ms long, duration_ms long"
EVENT = "deck_id long, slide_num int, ev_idx int, text string, offset_ms long, duration_ms long"


def timed(spark, segs, events, **kw):
    s = spark.createDataFrame([(1, 1, i, a, b, "t") for i, (a, b) in enumerate(segs)], SEG)
    m = spark.createDataFrame([(1, 1, i, *e) for i, e in enumerate(events)], MATCH)
    return [(r.start_ms, r.end_ms, r.interpolated) for r in align.align(s, m, **kw).orderBy("seg_idx").collect()]


def test_in_order_with_extension_over_a_pause(spark):
    assert timed(spark, [(0, 2), (2, 4)], [(0, 1, 0, 100), (1, 2, 100, 100), (2, 3, 2000, 100)]) == [(0, 1850, False), (2000, 2100, False)]


def test_short_pause_keeps_the_end(spark):
    assert timed(spark, [(0, 2), (2, 4)], [(0, 2, 0, 900), (2, 4, 1000, 100)])[0] == (0, 900, False)


def test_straddling_word_is_clamped(spark):
    assert timed(spark, [(0, 3), (3, 6)], [(0, 2, 0, 500), (2, 4, 500, 1000), (4, 6, 1500, 500)]) == [(0, 500, False), (500, 2000, False)]


def test_never_a_negative_length(spark):
    out = timed(spark, [(0, 2), (2, 4)], [(0, 2, 5000, 500), (2, 4, 100, 100)])
    assert all(b >= a for a, b, _ in out)


def test_missing_words_are_interpolated(spark):
    assert timed(spark, [(0, 2), (2, 4), (4, 6)], [(0, 2, 0, 300), (4, 6, 900, 300)], gap_ms=0) == [(0, 300, False), (300, 900, True), (900, 1200, False)]
    with pytest.raises(InvalidInput):
        timed(spark, [(0, 2)], [(0, 2, 0, 300)], gap_ms=-1)


def test_search_rules():
    assert find_span("abcabc", 1, "abc", []) == (3, 6)
    assert find_span("x" * 300 + "needle", 0, "needle", []) == (300, 306)
    assert find_span("say Hello", 0, "hello", []) == (4, 9)
    assert find_span("nothing", 0, "zebra", []) is None
    # The first "go" is nearer, but what follows it is far off.
    text = "go " + "z" * 30 + " go home now please"
    assert find_span(text, 0, "go", ["home", "now", "please"]) == (34, 36)
    assert find_span("go home then go home now", 0, "go", ["home"]) == (0, 2)  # about as good, and nearer


def plain_match(text, words):
    """The rule, written down step by step."""
    cursor, out = 0, []
    said = [(i, w) for i, w in enumerate(words) if w.strip()]
    for n, (i, w) in enumerate(said):
        places = [p for p in range(cursor, min(len(text), cursor + 200) - len(w) + 1) if text.startswith(w, p)]
        follow = [x for _, x in said[n + 1 : n + 4]]
        if len(places) > 1 and follow:
            cost = {}
            for p in places:
                at, c = p + len(w), 0
                for x in follow:
                    k = text.find(x, at)
                    c = c + k - at if k >= 0 and c is not None else None
                    at = k + len(x)
                    if c is None:
                        break
                if c is not None:
                    cost[p] = c
            best = [p for p in places if p in cost and cost[p] <= min(cost.values()) + 10] or places[:1]
            at = min(best)
        elif places:
            at = places[0]
        else:
            at = text.find(w, cursor)
            if at < 0:
                k = text[cursor : cursor + 200].lower().find(w.lower())
                at = cursor + k if k >= 0 else -1
        if at >= 0:
            out.append((i, at, at + len(w)))
            cursor = at + len(w)
    return out


def test_full_rule_against_the_plain_one(spark):
    import random

    r = random.Random(2)
    rows = []
    for k in range(60):
        words = [r.choice(["an", "a", "the", "then", "İs", "ok", "Go", "go"]) for _ in range(r.randint(1, 60))]
        heard = [w for w in words if r.random() > 0.2] + r.choice([[], ["zzz"], [" "]])
        rows.append((k, r.choice([" ", ""]).join(words), heard))
    slides = spark.createDataFrame([(k, 1, t) for k, t, _ in rows], "deck_id long, slide_num int, notes string")
    events = spark.createDataFrame([(k, 1, i, w, 100 * i, 90) for k, _, ws in rows for i, w in enumerate(ws)], EVENT)
    got = {}
    for x in align.match(slides, events).orderBy("deck_id", "ev_idx").collect():
        got.setdefault(x.deck_id, []).append((x.ev_idx, x.source_start_offset, x.source_end_offset))
    assert got == {k: m for k, t, ws in rows if (m := plain_match(t, ws))}
    assert all(b <= c for m in got.values() for (_, _, b), (_, c, _) in zip(m, m[1:], strict=False))


@pytest.mark.parametrize(("text", "pattern"), [("aaaa", "aa"), ("abab", "ab"), ("", "a"), ("x", ""), ("a\\Eb\\E", "\\E"), ("😀é😀", "😀"), (".a.a", ".a"), ("\n\na", "\n")])
def test_occurrences(spark, text, pattern):
    got = spark.createDataFrame([(text, pattern)], "t string, p string").select(align.occurrences(F.col("t"), F.col("p")).alias("x")).first().x
    assert got == [i for i in range(len(text)) if pattern and text.startswith(pattern, i)]


def spoken(spark, skip):
    text = "The first part is read. This part in the middle is not read at all. The last part is read."
    events, at = [], 0
    for i, c in enumerate(text):
        if c not in " ." and not skip[0] <= i < skip[1]:
            events.append((1, 1, i, i, i + 1, at, 90))
        if not skip[0] <= i < skip[1]:
            at += 100
    return spark.createDataFrame([(1, 1, text)], "deck_id long, slide_num int, notes string"), spark.createDataFrame(events, MATCH), text


def test_dropped_narration(spark):
    slides, matched, text = spoken(spark, (24, 66))
    (r,) = gaps.dropped_narration(slides, matched).collect()
    assert "This part in the middle" in r.skipped_text and r.gap_ms >= 0
    assert text[r.source_start_offset : r.source_end_offset] == r.skipped_text
    slides, matched, _ = spoken(spark, (0, 0))
    assert gaps.dropped_narration(slides, matched).count() == 0
    assert gaps.dropped_narration(slides, matched.limit(1)).count() == 0


def test_worst_slide_of_equals_is_the_later(spark):
    r = spark.createDataFrame([(1, 1, 400), (1, 2, -400), (1, 3, 10)], "deck_id long, slide_num int, gap_ms long")
    assert gaps.worst_slide(r).first().worst_slide == 2


def test_scales(spark):
    starts = timeline.predicted_starts(spark.createDataFrame([(1, 1, 10_000), (1, 2, 10_000), (1, 3, None), (1, 4, 10_000)], "deck_id long, slide_num int, audio_ms long"))
    bounds = spark.createDataFrame([(1, 1, 0, 11_000), (1, 2, 12_000, None), (1, 4, 28_000, None)], "deck_id long, slide_num int, start_ms long, end_ms long")
    got = {r.slide_num: (r.start_ms, round(r.scale, 4), r.code) for r in timeline.scales(starts, bounds).collect()}
    inferred = 16_000 / 15_000
    assert got == {1: (0, 1.1, None), 2: (12_000, round(inferred, 4), None), 3: (20_000, 1.0, "unmeasured"), 4: (28_000, round((1.1 + inferred) / 2, 4), "average_scale")}


def test_fit(spark):
    points = lambda rows: spark.createDataFrame([(1, float(m), float(o)) for m, o in rows], "deck_id long, measured double, observed double")
    assert calibrate.fit_scale(points([(10, 10.0121), (20, 20.0242)]), ["deck_id"]).first().k == pytest.approx(1.00121)
    with pytest.raises(InvalidInput):
        calibrate.require_scale(calibrate.fit_scale(points([(0, 1), (0, 2)]), ["deck_id"]))
    with pytest.raises(InvalidInput):
        calibrate.require_scale(calibrate.fit_scale(points([(5, 5)]), ["deck_id"]))
    assert calibrate.report(points([(10, 10), (10, 16)]), ["deck_id"]).first().doubtful


def test_cuts_and_clips(spark):
    starts = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate([0, 10_000, 20_000, 30_000])], "deck_id long, slide_num int, at_ms long")
    total = spark.createDataFrame([(1, 40_000)], "deck_id long, total_ms long")
    cuts = intervals.equal_cuts(starts, total, 2)
    assert [(r.slide_num, r.at_ms) for r in cuts.collect()] == [(3, 20_000)]
    assert intervals.equal_cuts(starts, total, 9).count() == 3  # fewer starts than cuts
    cues = spark.createDataFrame([(1, 0, 0, 5000, "a"), (1, 1, 18_000, 22_000, "b"), (1, 2, 20_000, 21_000, "c"), (1, 3, 15_000, 20_000, "d")], "deck_id long, cue_idx int, start_ms long, end_ms long, text string")
    got = {(r.part_idx, r.text): (r.start_ms, r.end_ms) for r in intervals.clip(cues, intervals.windows(cuts, total)).collect()}
    assert got == {(0, "a"): (0, 5000), (0, "b"): (18_000, 20_000), (0, "d"): (15_000, 20_000), (1, "b"): (0, 2000), (1, "c"): (0, 1000)}
    with pytest.raises(InvalidInput):
        intervals.require_cuts(starts, spark.createDataFrame([(1, 4)], "deck_id long, slide_num int"))


def test_srt(spark):
    text = "﻿1\r\n00:00:01,000 --> 00:00:02,500\r\nfirst\r\nline\r\n\r\nbroken\r\n\r\n2\r\n00:01:00.250 --> 01:00:00,000\r\nlast\r\n"
    files = spark.createDataFrame([(1, text.lstrip("﻿")), (2, ""), (3, "  \n")], "deck_id long, srt string")
    got = [(r.deck_id, r.cue_idx, r.start_ms, r.end_ms, r.text) for r in srt.parse_srt(files, ["deck_id"]).orderBy("cue_idx").collect()]
    assert got == [(1, 0, 1000, 2500, "first\nline"), (1, 1, 60_250, 3_600_000, "last")]
    cues = spark.createDataFrame([(1, 0, 362_439_999, 362_440_000, "x"), (1, 1, -5, 10, "y")], "deck_id long, cue_idx int, start_ms long, end_ms long, text string")
    assert srt.format_srt(cues, ["deck_id"], ["cue_idx"]).first().srt == "1\n100:40:39,999 --> 100:40:40,000\nx\n\n2\n00:00:00,000 --> 00:00:00,010\ny\n"


def test_blocks_without_times_are_passed_over(spark):
    """Also such as have lines enough; and times that a line break parts are none."""
    text = "a note\nof two lines\n\n1\n00:00:01,000\n --> 00:00:02,500\n\n \n\t\n2\nat 00:00:01,000-->00:00:02.500 x\nfirst\n00:00:03,000 --> 00:00:04,000\n\n00:00:05,000 --> 00:00:06,000\n\n3\n00:00:07,000 \t --> 10:00:08,000\n \x0b"
    files = spark.createDataFrame([(1, text), (2, "no\ntimes"), (3, None), (4, "5\n00:00:01,000 --> 00:00:02,500\n")], "deck_id long, srt string")
    got = [tuple(r) for r in srt.parse_srt(files, ["deck_id"]).orderBy("deck_id", "cue_idx").collect()]
    assert got == [(1, 0, 1000, 2500, "first\n00:00:03,000 --> 00:00:04,000"), (1, 1, 7000, 36_008_000, ""), (4, 0, 1000, 2500, "")]


def test_lookups(spark):
    entries = spark.createDataFrame([(1, 1, 0, "a.mp3"), (1, 1, 1, "b.mp3"), (1, 2, 0, "")], "deck_id long, slide_num int, entry_idx int, audio_file string")
    assert merge.one_per_slide(entries, "entry_idx", last=False).where("slide_num = 1").first().audio_file == "a.mp3"
    assert [(r.slide_num, r.audio_file) for r in merge.audio_map(entries).collect()] == [(1, "b.mp3")]
    slides = spark.createDataFrame([(1, 1, "n", ""), (1, 2, " ", " "), (1, 3, None, None)], "deck_id long, slide_num int, notes string, subtitle_text string")
    assert [r.x for r in slides.orderBy("slide_num").select(merge.spoken_text().alias("x")).collect()] == ["n", " ", None]
    assert [r.slide_num for r in slides.where(merge.narratable()).collect()] == [1]
    with pytest.raises(InvalidInput):
        merge.require_notes(slides)
    with pytest.raises(InvalidInput):
        merge.require_selected(slides, spark.createDataFrame([(1, 9)], "deck_id long, slide_num int"))


def test_gaps_are_filled_from_the_events_behind_them(spark):
    """Against the rule told segment by segment, with the events put in order once: nothing is summed over what is left of a slide at each row."""
    import random

    r = random.Random(9)
    segs, events, want = [], [], {}
    for deck in range(40):
        at, mine, said = 0, [], []
        for i in range(r.randint(1, 12)):
            a = at + r.randint(0, 2)
            at = a + r.randint(1, 4)
            mine.append((i, a, at))
        for k in range(r.randint(0, 6)):
            a = r.randint(0, at)
            said.append((k, a, a + r.randint(0, 3), r.randint(0, 50), r.randint(1, 9)))
        base = 0
        for i, a, b in mine:
            own = [(o, o + n) for _, x, y, o, n in said if any(a <= c < b for c in range(x, max(y, x + 1)))]
            behind = [o for _, x, o in sorted((x, k, o) for k, x, _, o, _ in said if x >= b)]
            start, end = (min(own)[0], max(e for _, e in own)) if own else (base, max(base, *behind[:1], 0))
            want[deck, i] = (start, end, not own)
            base = end
        segs += [(deck, 1, i, a, b, "t") for i, a, b in mine]
        events += [(deck, 1, *e) for e in said]
    s, m = spark.createDataFrame(segs, SEG), spark.createDataFrame(events, MATCH)
    for out in (align.filled(align.met(s, m)), align.interpolate(align.overlaps(s, m), m)):
        assert {(x.deck_id, x.seg_idx): (x.start_ms, x.end_ms, x.interpolated) for x in out.collect()} == want
        assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_characters_are_not_sent_again(spark, sf):
    """Slides are dealt out as rows of text; their characters stay where they are."""
    from cueloom.queries import QUERIES

    plan = QUERIES["aln6_interpolate"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    # One of lines of text for segments, one of whole notes for events; none above where they come together.
    assert plan.count("Exchange hashpartitioning") == 2 and plan.index("Union") < plan.index("Exchange hashpartitioning")


def test_places_are_not_compared_where_the_next_words_follow():
    """The nearest place is taken at once if the following words are next to it; by the plain rule the same place."""
    import random

    r = random.Random(4)
    for _ in range(300):
        text = "".join(r.choices("aab İé", k=r.randint(0, 500)))
        heard = [c for c in text if r.random() > 0.1] + r.choice([[], ["zz"], ["A"]])
        words = [w for w in heard if w.strip()]
        assert [s for s in align.walk(text, words) if s] == [(a, b) for _, a, b in plain_match(text, words)]
    asked, whole = [], align.Places.span
    text = "what is read here is read as it stands " * 20
    try:
        align.Places.span = lambda self, *a: asked.append(a) or whole(self, *a)
        assert [a for a, _ in align.walk(text, [c for c in text if c != " "])] == [i for i, c in enumerate(text) if c != " "]
    finally:
        align.Places.span = whole
    assert not asked


@pytest.mark.parametrize("name", ["aln8_balanced_captions", "aln4_match_events"])
def test_events_stay_where_lines_and_notes_come_to_them(spark, sf, name):
    from cueloom.queries import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Union") < plan.index("Exchange hashpartitioning")


def test_lines_are_met_where_their_events_are_matched(spark):
    """The same as by both steps, with nulls, slides of one part only and words that are not there; and no event comes back."""
    import random

    from cueloom.operators import segment

    r = random.Random(9)
    slides, events = [(1, 1, None), (1, 2, "no events here."), (1, 3, ""), (2, 1, "İİİ x"), (2, 2, "One, two. Three four five six seven, eight nine ten.\n\n, eleven")], []
    for deck in range(3, 40):
        slides.append((deck, 1, "".join(r.choices(["ab ", "c", "。", ", ", "字", "\n", ". ", "word "], k=r.randint(0, 150)))))
    for deck, n, notes in [*slides, (99, 1, "notes that are not there")]:
        said = [w for w in (notes or "said").split() for w in (w[:2], w[2:]) if r.random() < 0.8]
        for i, w in enumerate([] if n == 2 and deck == 1 else [*said, "zz", " "]):
            events.append((deck, n, r.choice([w, w, w, w.lower(), None]), r.choice([i * 100, i * 100, r.randint(0, 900), None]), r.choice([50, 90, None]), i))
    s = spark.createDataFrame(slides, "deck_id long, slide_num int, notes string")
    e = spark.createDataFrame(events, "deck_id long, slide_num int, text string, offset_ms long, duration_ms long, ev_idx int")
    lines = segment.segments(s.join(e.select("deck_id", "slide_num").distinct(), ["deck_id", "slide_num"], "left_semi"), ["deck_id", "slide_num"], max_width=20)
    columns = ["deck_id", "slide_num", "seg_idx", "start", "end", "text", "raw_start", "raw_end", "next_ms"]
    want = align.met(lines.withColumnsRenamed({"source_start_offset": "start", "source_end_offset": "end"}), align.match(s, e)).select(*columns)
    got = align.match_lines(s, e, segment.Segmenter(20))
    assert got.columns == columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.where("raw_start is null").count() > 9


def test_whole_way_sends_no_events(spark, sf):
    """Notes are dealt out twice, for their events and to meet them; what comes back from Python are lines."""
    from cueloom.queries import QUERIES

    plan = QUERIES["tl3_subtitles"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "sequence(source_start_offset" not in plan


def odd_events(seed):
    """Segments and events of 60 slides: nulls, events of no length, and long ones over others."""
    import random

    r = random.Random(seed)
    segs, events = [], []
    for deck in range(60):
        at = 0
        for i in range(r.randint(0, 9)):
            a = at + r.randint(0, 2)
            at = a + r.randint(1, 4)
            segs.append((deck, 1, i, a, at, "t"))
        for k in range(r.randint(0, 12)):
            a = r.randint(0, at)
            events.append((deck, 1, k, a, a + r.choice([0, 1, 2, 9]), r.choice([None, *range(0, 900, 50)]), r.choice([None, 90, 90, 300])))
    return segs, events


def test_segments_are_timed_where_they_are_met(spark):
    """By all events of a slide, one by one; then the same as by one step after another."""
    segs, events = odd_events(5)
    s, m = spark.createDataFrame(segs, SEG), spark.createDataFrame(events, MATCH)
    want = set()
    for deck, n, i, a, b, _ in segs:
        mine = sorted((x, k, y, o, d) for e, _, k, x, y, o, d in events if e == deck)
        over = [(o, None if o is None or d is None else o + d) for x, _, y, o, d in mine if x < b and max(y, x + 1) > a]
        behind = [o for x, _, _, o, _ in mine if x >= b and o is not None]
        want.add((deck, n, i, min((o for o, _ in over if o is not None), default=None), max((e for _, e in over if e is not None), default=None), *(behind[:1] or [None])))
    met = align.met(s, m)
    assert {tuple(x) for x in met.select("deck_id", "slide_num", "seg_idx", "raw_start", "raw_end", "next_ms").collect()} == want
    for gap, steps in ((None, align.filled(met)), (150, align.clamp(align.filled(met)))):
        got = align.timed(s, m, gap)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, steps.select(*got.columns).collect())) and got.count() == len(segs)


def test_events_that_are_told_late(spark, sf, tmp_path):
    """The same as by an event a row, with notes that are there twice, empty ones and characters of many bytes."""
    from cueloom.queries import QUERIES
    from cueloom.sources import bindings

    notes = ["A b. Ça va? 字😀!\nx", "", " .,", None, "The quick brown fox jumps over the lazy dog, again and again and again, until it is dark. Then it rests."]
    rows = [(deck, turn, "user", notes[(deck + turn) % 5]) for deck in range(12) for turn in range(4)] + [(3, 1, "user", "x yz. Again")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for d in (sf, str(tmp_path)):
        places = spark.createDataFrame([(deck, n, i, 7 * i, 7 * i + 5) for deck in range(150) for n in range(1, 9) for i in range(15)], "deck_id long, slide_num int, seg_idx int, start int, end int")
        late, rows = align.met(places, bindings.told(spark, d)), align.met(places, bindings.matched(spark, d))
        assert sorted(map(repr, late.collect())) == sorted(map(repr, rows.collect())) and late.where("raw_start is not null").count() > 20
    for name in ("predictive_captions", "aln7_clamp", "tl3_measured_captions"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(filter" not in plan and "explode(sequence" not in plan and plan.count("found(") == 1


def test_starts_come_to_whole_slides(spark):
    """No caption is sent to its slide's start, and captions are those that are placed one by one, also of a slide that is there twice."""
    from collections import Counter

    from cueloom.operators import timeline
    from cueloom.plans import captions

    rows = [(deck, s, f"One of {deck}. Two, {s}!\nThree?", 3000 + s) for deck in range(6) for s in range(1, 5)] + [(1, 2, "Again. And again.", 9), (2, 9, None, None)]
    slides = spark.createDataFrame(rows, "deck_id long, slide_num int, notes string, audio_ms long")
    matched = slides.where("notes is not null").selectExpr("deck_id", "slide_num", "explode(sequence(0, 12, 3)) ev_idx").distinct().selectExpr("*", "ev_idx source_start_offset", "ev_idx + 1 source_end_offset", "ev_idx * 200L offset_ms", "160L duration_ms")
    got = captions.predictive(slides, matched)
    want = timeline.place(captions.slide_captions(slides, matched), timeline.predicted_starts(slides.select("deck_id", "slide_num", "audio_ms")))
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(map(tuple, want.collect()))
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(captions.predictive(slides, matched)) == exchanges(timeline.place(captions.slide_captions(slides, matched), timeline.predicted_starts(slides.select("deck_id", "slide_num", "audio_ms")))) - 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
