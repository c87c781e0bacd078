"""Matching entities across sources without keys: sorted neighbourhood over several composite sort keys."""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleforge.llm.names import fold, given_names, parse_name, same_given, typo_distance
from tripleforge.llm.spellings import components
from tripleforge.runtime import materialize, spread

#: Ranks per bucket of the sliding window; buckets overlap by the width of the window.
BUCKET = 20_000

#: What a video's title says if the video does not present the recording itself.
NOT_PRESENTING = re.compile(
    r"\bcover(?:ed)?\b|\bkaraoke\b|\bhow to play\b|\blessons?\b|\btutorial\b|\breact(?:s|ing|ion)?\b|\btrailer\b|\bteaser\b|\bbehind the scenes\b"
    r"|\bending explained\b|\bscore suite\b|\binterview\b|\breview\b|\bparody\b|\bmash-?up\b|\bsheet music\b|\bmaking of\b|\bbacking track\b"
)
#: Remarks on how a recording is presented, and what a place of performance begins with.
_REMARK = (
    r"(?:official\s*)?(?:music\s*|lyrics?\s*|full\s*)?(?:audio|video|visuali[sz]er|lyrics?|clip|song)"
    r"|remaster(?:ed)?(?:\s*\d{4})?|(?:\d{4}\s*)?remaster|hd|hq|4k|uhd|\d{3,4}p|official"
)
_BRACKETED = re.compile(rf"[(\[]\s*(?:{_REMARK}|live(?:\s[^)\]]*)?)\s*[)\]]", re.IGNORECASE)
_TRAILING = re.compile(rf"\s(?:\||-|–|—|//)\s*(?:{_REMARK})\s*$", re.IGNORECASE)
_LIVE = re.compile(r"live(?:\s.*)?", re.IGNORECASE)
_FROM = re.compile(r"\(\s*from\s+[\"“”']?(.*?)[\"“”']?\s*\)|\[([^\]]*)\](?=\s*$|\s+(?:-|–|—|:|//|\||~|•)\s)", re.IGNORECASE)
_SCORE = re.compile(r"(.*\S)\s+(?:OST|(?:original\s+)?soundtrack)", re.IGNORECASE)
_BREAK = re.compile(r"\s+(?:-|–|—|:|//|\||~|•)\s+")
_CREDIT = re.compile(r"(?:performed by|sung by|artist:|music:|composed by|composer:|performer:)\s*(.+?)(?:\.(?=\s+[A-Z]|\s*$)|;|\n|$)", re.IGNORECASE)
_CHANNEL = re.compile(r"(?:\s*-\s*topic|\s*official(?:\s+channel)?|\s*vevo|(?<=\S)TV|\s+tv|\s+music|\s+channel)\s*$", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ])")


def title_key(title: str | None) -> str:
    """Letters and digits of a title without accents, 'and' and signs."""
    words = re.findall(r"[^\W_]+", fold(title or ""))
    return "".join(w for w in words if w != "and")


def channel_artist(channel: str | None) -> str:
    """A channel's name without what channels add to an artist's, words written together taken apart."""
    text = (channel or "").strip()
    while (cut := re.sub(r"(?<=[^\s])TV$", "", _CHANNEL.sub("", text)).strip()) != text and cut:
        text = cut
    return _CAMEL.sub(" ", text)


def readings(title: str | None, channel: str | None, description: str | None) -> list[tuple[str, str, str]]:
    """Ways to read a video as (song title, artist, film), best first; empty if it does not present a recording.

    Song, artist, film and remarks may stand in any order. A part that names a soundtrack is the film, unless nothing else
    is left. A part such as "Live in Paris" says where a recording was made; only beside a single other part it
    may be a title as well.
    """
    text = " ".join((title or "").split())
    if not text or NOT_PRESENTING.search(fold(text)):
        return []
    film = ""
    while True:
        shorter = _TRAILING.sub("", _BRACKETED.sub("", text)).strip()
        if m := _FROM.search(shorter):
            film = film or next(x for x in m.groups() if x is not None)
            shorter = (shorter[: m.start()] + shorter[m.end() :]).strip()
        if shorter == text:
            break
        text = shorter
    parts = [p for p in _BREAK.split(text) if p]
    scores = [m[1] for p in parts if (m := _SCORE.fullmatch(p))]
    if scores and len(scores) < len(parts):
        film = film or scores[0]
        parts = [p for p in parts if not _SCORE.fullmatch(p)]
    places = [p for p in parts if _LIVE.fullmatch(p)]
    if len(places) < len(parts):
        parts = [p for p in parts if p not in places]
    else:
        places = []
    others = [m[1] for m in _CREDIT.finditer(description or "")]
    others.append(channel_artist(channel))
    out = []
    for i, part in enumerate(parts):
        out += [(other, part, film) for j, other in enumerate(parts) if j != i]
    for part in parts:
        if m := re.search(r"^(.+)\s+by\s+(.+)$", part, re.IGNORECASE):
            out.append((m[1], m[2], film))
    out += [(p, a, film) for p in parts for a in others if a]
    if len(parts) == 1:
        out += [(place, a, film) for place in places for a in (*parts, *others) if a]
    return list(dict.fromkeys(out))


def sort_keys() -> Column:
    """Composite keys of a reading: either end of the artist's name, and what precedes the last letters, with the title from
    either end.

    A typo in each of the two fields leaves one key that agrees up to a late place, so both records stay neighbours.
    """
    n = F.length("family")
    middle = F.substring("family", F.greatest(n - 7, F.lit(1)), F.least(F.lit(4), F.greatest(n - 4, F.lit(0))))
    ends = (F.substring("family", 1, 4), F.substring(F.reverse("family"), 1, 4), middle)
    pairs = [(end, t) for end in ends for t in (F.col("title"), F.reverse("title"))]
    return F.array(*[F.concat(F.lit(str(k)), end, F.lit("|"), t) for k, (end, t) in enumerate(pairs)])


def _title_of(key: str) -> str:
    """The title within a sort key, which every other key holds backwards."""
    title = key[key.index("|") + 1 :]
    return title[::-1] if key[0] in "135" else title


def sliding_pairs(records: DataFrame, payload: list[str], compare: Callable, schema: str, width: int) -> DataFrame:
    """Runs ``compare`` over all pairs of records at most ``width`` places apart in the order of ``key`` and the payload.

    ``records`` has a string column key and the payload columns. Ranks are global: places within sorted partitions
    plus the sizes of the partitions before (one count per partition reaches the driver). Buckets of consecutive
    ranks are streamed, each preceded by the last records of the bucket before it, so no pair is lost at borders.
    ``compare(frame, new)`` gets records in order of rank with the place of the first that is new.
    """
    spark = records.sparkSession
    placed = records.repartitionByRange("key", *payload).sortWithinPartitions("key", *payload)
    placed = materialize(placed.select("key", *payload, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")), "sorted")
    counts = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts, before = [], 0
    for part in sorted(counts):
        starts.append((part, before))
        before += counts[part]
    ranked = placed.join(F.broadcast(spark.createDataFrame(starts, "part int, start long")), "part").withColumn("rank", F.col("place") + F.col("start")).drop("part", "place", "start")
    bucket = F.expr(f"rank div {BUCKET}")
    halo = ranked.where(f"rank % {BUCKET} >= {BUCKET - width}").withColumn("bucket", bucket + 1).withColumn("native", F.lit(False))
    every = ranked.withColumn("bucket", bucket).withColumn("native", F.lit(True)).union(halo)
    ordered = every.repartition("bucket").sortWithinPartitions("bucket", "rank")

    def slide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None
        for frame in frames:
            joined = frame if tail is None else pd.concat([tail, frame], ignore_index=True)
            yield compare(joined, 0 if tail is None else len(tail), width)
            tail = joined.iloc[-width:].reset_index(drop=True)

    return ordered.mapInPandas(slide, schema)


def _agree(a: tuple[str, str, str], b: tuple[str, str, str]) -> float:
    """Agreement of two parsed artists between 0 (different) and 1."""
    kind_a, family_a, given_a = a
    kind_b, family_b, given_b = b
    if (kind_a == "group") != (kind_b == "group"):
        return 0.0
    slips = typo_distance(family_a, family_b, 2) if min(len(family_a), len(family_b)) >= 6 else 3 * (family_a != family_b)
    if slips > 2:
        return 0.0
    if kind_a == "group":
        return 0.0 if given_a != given_b or slips > 1 else 1 - 0.1 * slips
    if kind_a == kind_b == "full":
        more = same_given(given_a, given_b)
        return 0.0 if more > 1 else 1 - 0.1 * (slips + more)
    if slips > 1:
        return 0.0
    if not given_a or not given_b:
        return 0.8 - 0.1 * slips
    firsts = [{x[0] for x in (*given_names(g), g)} for g in (given_a, given_b)]
    return 0.9 - 0.1 * slips if firsts[0] & firsts[1] else 0.0


def _compare(frame: pd.DataFrame, new: int, width: int) -> pd.DataFrame:
    """Candidate pairs of a track and a video: same block, like titles, agreeing artists."""
    block = np.array([zlib.crc32(k[:6].encode()) for k in frame["key"]], dtype=np.int64)
    native, side, bucket = frame["native"].to_numpy(), frame["side"].to_numpy(), frame["bucket"].to_numpy()
    titles, artists = [_title_of(k) for k in frame["key"]], list(zip(frame["kind"], frame["family"], frame["given"], strict=True))
    length = np.array([len(t) for t in titles])
    # one typo leaves the first or the last three letters of a title as they were
    head, tail = (np.array([zlib.crc32(t.encode()) for t in ends], dtype=np.int64) for ends in ([t[:3] for t in titles], [t[-3:] for t in titles]))
    ids, songs, kept = frame["rid"].to_numpy(), [], []
    for off in range(1, min(width, len(frame) - 1) + 1):
        at = np.arange(max(new, off), len(frame))
        at = at[(block[at] == block[at - off]) & (side[at] != side[at - off]) & (bucket[at] == bucket[at - off]) & (native[at] | native[at - off]) & (np.abs(length[at] - length[at - off]) <= 1) & ((head[at] == head[at - off]) | (tail[at] == tail[at - off]))]
        for i in at:
            j = i - off
            slips = 0 if titles[i] == titles[j] else typo_distance(titles[i], titles[j]) if max(length[i], length[j]) > 5 else 2
            if slips > 1 or not (artist := _agree(artists[i], artists[j])):
                continue
            track, video = (i, j) if side[i] == 0 else (j, i)
            songs.append((ids[track], ids[video], slips, 1 - 0.2 * slips, artist))
    return pd.DataFrame(songs, columns=["track", "video", "slips", "title_agrees", "artist_agrees"])


def _less_a_letter(text: str) -> list[int]:
    """Hashes of a text and of what is left of it without each of its letters, in time proportional to its length."""
    base, modulus, before, powers = 1_000_003, (1 << 61) - 1, [0], [1]
    for c in text:
        before.append((before[-1] * base + ord(c)) % modulus)
        powers.append(powers[-1] * base % modulus)
    n, whole = len(text), before[-1]
    return list({whole, *((before[i] * powers[n - 1 - i] + whole - before[i + 1] * powers[n - 1 - i]) % modulus for i in range(n))})


def _title_pairs(tracks: DataFrame, videos: DataFrame) -> DataFrame:
    """(title of a track, wanted, slips): all titles of videos that are it, or no track's title and one typo away.

    Titles one typo apart have equal texts among themselves and what a letter less leaves of them.
    """

    def less(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, part) for i, t in zip(frame["id"], frame["title"], strict=True) for part in _less_a_letter(t)]
            yield pd.DataFrame(rows, columns=["id", "part"])

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[[typo_distance(a, b) <= 1 for a, b in zip(frame["title"], frame["wanted"], strict=True)]].assign(slips=1)

    named = lambda df: df.select(F.xxhash64("title").alias("id"), "title")
    parts = lambda df: named(df).where("length(title) >= 5").mapInPandas(less, "id long, part long")
    unknown = materialize(videos.join(tracks, "title", "left_anti"), "titles")
    met = parts(tracks).join(parts(unknown).toDF("other", "part"), "part").select("id", "other").distinct()
    met = met.join(named(tracks), "id").join(named(unknown).toDF("other", "wanted"), "other").where("greatest(length(title), length(wanted)) > 5").select("title", "wanted")
    same = tracks.join(videos, "title", "left_semi").select("title", F.col("title").alias("wanted"), F.lit(0).alias("slips"))
    return same.union(met.mapInPandas(near, "title string, wanted string, slips int"))


def equal_pairs(readings_: DataFrame) -> DataFrame:
    """Pairs of like titles whose family names begin or end alike, however many records lie between them.

    One typo leaves the first or the last two letters of a family name as they were, so only family names with a typo
    at both ends are left to the sliding window. Adaptive execution splits what frequent titles and names gather.
    """
    field = ["rid", "title", "kind", "family", "given"]
    ends = F.array(F.concat(F.lit("a"), F.substring("family", 1, 2)), F.concat(F.lit("z"), F.substring("family", -2, 2)))
    side = lambda n: readings_.where(f"side = {n}").select(*field, F.explode(ends).alias("end"))
    titles = _title_pairs(*(materialize(readings_.where(f"side = {n}").select("title").distinct(), "titles") for n in (0, 1)))
    videos = side(1).toDF("video", "wanted", "kind_b", "family_b", "given_b", "end").join(titles, "wanted")
    met = side(0).withColumnRenamed("rid", "track").join(videos, ["title", "end"])
    met = met.where("(kind = 'group') = (kind_b = 'group') and (end like 'a%' or left(family, 2) <> left(family_b, 2)) and abs(length(family) - length(family_b)) <= 2").where(F.levenshtein("family", "family_b", 4) >= 0)

    def agree(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ours, theirs = (zip(*(frame[c + x] for c in ("kind", "family", "given")), strict=True) for x in ("", "_b"))
            out = frame[["track", "video", "slips"]].assign(title_agrees=1 - 0.2 * frame["slips"], artist_agrees=[_agree(a, b) for a, b in zip(ours, theirs, strict=True)])
            yield out[out["artist_agrees"] > 0]

    columns = ["track", "video", "slips", "kind", "family", "given", "kind_b", "family_b", "given_b"]
    return met.select(*columns).mapInPandas(agree, "track long, video long, slips int, title_agrees double, artist_agrees double")


def artist_entities(artists: list[tuple[str, str, str]]) -> list[int]:
    """The entity of each (kind, family, given): the place of its first spelling.

    As for spellings of names, full names and groups are one if there is one typo at most, chains of such pairs belong
    together, and an initial or bare family name joins the only artist that agrees with it, if there is just one.
    """
    parent = list(range(len(artists)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    near: dict[int, list[int]] = {}
    for i, (kind, family, _) in enumerate(artists):
        if kind in ("full", "group"):
            for part in _less_a_letter(family):
                near.setdefault(part, []).append(i)
    alike = lambda i: {j for part in _less_a_letter(artists[i][1]) for j in near.get(part, ())}
    for i, (kind, _, _) in enumerate(artists):
        if kind in ("full", "group"):
            for j in alike(i):
                if j < i and artists[j][0] == kind and _agree(artists[i], artists[j]) >= 0.9:
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
    for i, (kind, _, _) in enumerate(artists):
        if kind in ("initial", "family"):
            met = {(root(j), _agree(artists[i], artists[j])) for j in alike(i)}
            best = max((a for _, a in met), default=0)
            fits = {r for r, a in met if a == best} if best > 0 else set()
            if len(fits) == 1:
                parent[i] = fits.pop()
    return [root(i) for i in range(len(artists))]


def assignment(weights: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairs (row, column) of the greatest total weight; weights of 0 are no pairs.

    Shortest augmenting paths with potentials (the Hungarian method), one row after the other.
    """
    if weights.shape[0] > weights.shape[1]:
        return sorted((r, c) for c, r in assignment(weights.T))
    n, m = weights.shape
    cost = -weights
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.full(m + 1, -1)
    for i in range(n):
        owner[m] = i
        least, back, done, j = np.full(m + 1, np.inf), np.full(m + 1, m), np.zeros(m + 1, dtype=bool), m
        while owner[j] >= 0:
            done[j] = True
            slack = cost[owner[j]] - u[owner[j]] - v[:m]
            better = ~done[:m] & (slack < least[:m])
            least[:m][better], back[:m][better] = slack[better], j
            open_ = np.where(done[:m], np.inf, least[:m])
            k = int(open_.argmin())
            step = open_[k]
            u[owner[done]] += step
            v[done] -= step
            least[~done] -= step
            j = k
        while j != m:
            owner[j] = owner[back[j]]
            j = back[j]
        owner[m] = -1
    return sorted((int(owner[j]), j) for j in range(m) if owner[j] >= 0 and weights[owner[j], j] > 0)


def _assigned(edges: list[tuple]) -> list[tuple[int, str, int, int, float]]:
    """(video, film, song, track, confidence) of one component of like readings.

    ``edges``: (track, video, film named, confidence, title and artist of both). Track readings with one title and one
    artist are a song, video readings with one title, artist and film a recording. Which artist an initial or bare family
    name in a video stands for is decided among those of the tracks, too.
    """
    ours = {e[0]: (e[4], e[5:8]) for e in edges}
    theirs = {(e[1], e[2]): (e[8], e[9:12]) for e in edges}

    def grouped(named: dict, extra, besides: list) -> dict:
        by_title: dict[str, list] = {}
        for node in sorted(named):
            by_title.setdefault(named[node][0], []).append(node)
        out = {}
        for title, nodes in by_title.items():
            entities = artist_entities([*besides, *(named[n][1] for n in nodes)])[len(besides) :]
            for node, e in zip(nodes, entities, strict=True):
                out[node] = (title, e, extra(node))
        return out

    song_of, recording_of = grouped(ours, lambda n: 0, []), grouped(theirs, lambda n: n[1], sorted({a for _, a in ours.values()}))
    songs, recordings = sorted(set(song_of.values())), sorted(set(recording_of.values()))
    weights = np.zeros((len(songs), len(recordings)))
    row, column = {s: i for i, s in enumerate(songs)}, {r: i for i, r in enumerate(recordings)}
    for e in edges:
        at = row[song_of[e[0]]], column[recording_of[e[1], e[2]]]
        weights[at] = max(weights[at], e[3])
    best: dict[int, tuple[int, float]] = {}
    left = list(range(len(recordings)))
    while left:
        pairs = assignment(weights[:, left]) if len(songs) > 1 else [(0, k) for k in range(len(left))]
        for s, k in pairs:
            best[left[k]] = (s, float(weights[s, left[k]]))
        left = [r for r in left if r not in best]
    members: dict[int, list[int]] = {}
    for track, s in song_of.items():
        members.setdefault(row[s], []).append(track)
    out = []
    for (video, film), r in recording_of.items():
        s, confidence = best[column[r]]
        out += [(video, film, min(members[s]), track, confidence) for track in members[s]]
    return out


def assign_recordings(edges: DataFrame) -> DataFrame:
    """One-to-one assignment between songs and recordings that maximises the total confidence.

    ``edges``: track, video, named (film), confidence and the readings of both sides. Readings that are connected by
    edges are one component, found by rounds of joins; a component is as large as its spellings are many, however often
    its title occurs. As a song may have several recordings (live, remastered, under another film), those left over are
    assigned again in the same manner until none is left.
    """
    pairs = edges.select(F.col("track").alias("a"), F.col("video").alias("b")).distinct()
    found = components(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), pairs)
    columns = ["track", "video", "named", "confidence", "title", "kind", "family", "given", "title_b", "kind_b", "family_b", "given_b"]
    held = edges.join(found.withColumnRenamed("node", "track"), "track").select("component", *columns)
    held = held.repartition("component").sortWithinPartitions("component")

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["video", "named", "song", "track", "confidence"]
        rows = itertools.chain.from_iterable(f.itertuples(index=False, name=None) for f in frames)
        out: list[tuple] = []
        for _, group in itertools.groupby(rows, key=lambda r: r[0]):
            out += _assigned([r[1:] for r in group])
            if len(out) >= BUCKET:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    return held.mapInPandas(solve, "video long, named string, song long, track long, confidence double")


def link_tracks(tracks: DataFrame, videos: DataFrame, width: int = 40) -> DataFrame:
    """Tracks and the videos that present them: (track_id, video_id, confidence between 0 and 1).

    ``tracks``: track_id, title, artist, film. ``videos``: video_id, title, channel_title, description. A video is
    read in several ways as title and artist; what says it is a cover, lesson, trailer and so on is left out. The
    distinct readings of both sides are sorted by each composite key; records at most ``width`` places apart, and at any
    distance those of like titles whose family names begin or end alike, are compared by the agreement of title (weight
    0.5), artist (0.4) and film (0.1), equal readings standing for all their records. A title with a typo counts only if
    it is not itself the title of another track.

    Uploads of one recording are grouped, songs and recordings are assigned one to one (see ``assign_recordings``), and
    the assignment is expanded to tracks and uploads. A video that can be read as several recordings keeps the one of
    greatest confidence, on ties that of the greatest song hash. Null or unreadable titles and artists match nothing;
    repeated records count once; other columns are ignored.
    """

    def read_tracks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for track, title, artist, film in zip(frame["track_id"], frame["title"], frame["artist"], frame["film"], strict=True):
                if (t := title_key(title)) and (p := parse_name(artist)):
                    rows.append((0, str(track), t, *p, title_key(film)))
            yield pd.DataFrame(rows, columns=["side", "id", "title", "kind", "family", "given", "film"])

    def read_videos(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for video, title, channel, description in zip(frame["video_id"], frame["title"], frame["channel_title"], frame["description"], strict=True):
                for song, artist, film in readings(title, channel, description):
                    if (t := title_key(song)) and (p := parse_name(artist)):
                        rows.append((1, video, t, *p, title_key(film)))
            yield pd.DataFrame(rows, columns=["side", "id", "title", "kind", "family", "given", "film"])

    schema = "side int, id string, title string, kind string, family string, given string, film string"
    a = spread(tracks.select("track_id", "title", "artist", "film").where("track_id is not null and title is not null and artist is not null"))
    b = spread(videos.select("video_id", "title", "channel_title", "description").where("video_id is not null and title is not null"))
    rows = a.mapInPandas(read_tracks, schema).union(b.mapInPandas(read_videos, schema))
    field = ["side", "title", "kind", "family", "given"]
    rows = materialize(rows.withColumn("rid", F.xxhash64(*field)), "readings")
    readings_ = materialize(rows.select("rid", *field).distinct(), "distinct")
    # the title is part of the key and need not be carried beside it
    records = readings_.select(F.explode(sort_keys()).alias("key"), "rid", "side", "kind", "family", "given")
    near = sliding_pairs(records, ["family", "given", "kind", "side", "rid"], _compare, "track long, video long, slips int, title_agrees double, artist_agrees double", width)
    pairs = materialize(near.union(equal_pairs(readings_)).distinct(), "pairs")
    titles = rows.where("side = 0").select("title").distinct()
    known = rows.where("side = 1").join(titles, "title", "left_semi").select(F.col("rid").alias("video")).distinct()
    pairs = pairs.where("slips = 0").union(pairs.where("slips > 0").join(known, "video", "left_anti").select(pairs.columns))
    ours = rows.where("side = 0").select(F.col("rid").alias("track"), F.col("film").alias("named")).distinct()
    theirs = rows.where("side = 1").select(F.col("rid").alias("video"), F.col("film").alias("named")).distinct()
    filmless = ours.groupBy("track").agg(F.max(F.col("named") == "").alias("filmless"))
    edges = pairs.join(theirs, "video").join(filmless, "track").join(ours.withColumn("same", F.lit(True)), ["track", "named"], "left")
    film = F.when((F.col("named") == "") | (F.col("filmless") & F.col("same").isNull()), 0.5).when(F.col("same"), 1.0).otherwise(0.0)
    edges = edges.withColumn("confidence", F.round(0.5 * F.col("title_agrees") + 0.4 * F.col("artist_agrees") + 0.1 * film, 4))
    side = lambda n, *names: readings_.where(f"side = {n}").select("rid", "title", "kind", "family", "given").toDF(*names)
    edges = edges.join(side(0, "track", "title", "kind", "family", "given"), "track").join(side(1, "video", "title_b", "kind_b", "family_b", "given_b"), "video")
    chosen = materialize(assign_recordings(materialize(edges, "edges")), "assigned")
    uploads = rows.where("side = 1").select(F.col("rid").alias("video"), F.col("film").alias("named"), F.col("id").alias("video_id")).distinct()
    best = chosen.select("video", "named", "song", "confidence").distinct().join(uploads, ["video", "named"]).groupBy("video_id").agg(F.max(F.struct("confidence", "song")).alias("m"))
    own = rows.where("side = 0").select(F.col("rid").alias("track"), F.col("id").alias("track_id")).distinct()
    song = chosen.select("song", "track").distinct().join(own, "track").select("song", "track_id").distinct()
    out = best.select("video_id", F.col("m.song").alias("song"), F.col("m.confidence").alias("confidence")).join(song, "song")
    return out.select(F.col("track_id").cast("long").alias("track_id"), "video_id", "confidence")
