"""Registered queries of sources, sinks, words and streams, on files made of the pixel fixtures, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import queries as q
from .functions import pixels as P
from .functions import timing, words
from .operators import aggregate, combine, delta, movtables, spatial
from .plans import files
from .plans import fixtures as fx
from .sources import container, images, quicktime
from .sources.folders import shared_folder
from .streaming import decode as streaming

LOW = f"select frame, idx, ((px >> 19) & 31) * 1024 + ((px >> 11) & 31) * 32 + ((px >> 3) & 31) as px from ({q.STD})"
PX = {"low.anim": LOW, "std.anim": q.STD, "rgba.anim": q.RGBA}


def _with_movie(part) -> str:
    """part(movie, sql of its pixels) of the three movies, one under another."""
    return " union all ".join(f"select '{m}' as movie, * from ({part(m, px)})" for m, px in PX.items())


def _new(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# -- words

def _split(s, d):
    nation = s.read.parquet(f"{d}/nation.parquet")
    k = F.col("n_nationkey").cast("long")
    op = F.when(F.pmod(k, F.lit(3)) == 0, "DUP").when(F.pmod(k, F.lit(3)) == 1, "COPY").otherwise("SKIP")
    # counts about the limit of 65535, a rest of one among them
    return nation.select(k.alias("run"), op.alias("op"), F.lit(0).cast("long").alias("start_idx"), (P.div(k, 3) * words.MAX_16 + F.pmod(k, F.lit(2)) + 1).alias("num"))


def _run_splits(s, d):
    return words.split_runs(_split(s, d), words.MAX_16).select("run", "op", "part", "start_idx", "num")


def _generic_words(s, d):
    rows = words.split_runs(_split(s, d), words.MAX_16)
    word = words.generic16(F.col("op"), F.col("num"), F.pmod("run", F.lit(4)))
    return rows.select("run", "part", word.alias("word")).select("run", "part", "word", *words.parts_of_generic16(F.col("word")))


_SPLIT_SQL = """select n_nationkey as run, case n_nationkey % 3 when 0 then 'DUP' when 1 then 'COPY' else 'SKIP' end as op, n_nationkey // 3 * 65535 + n_nationkey % 2 + 1 as num from nation"""
_PARTS_SQL = f"""select run, op, part, cast(lo as bigint) as start_idx, cast(hi - lo as bigint) as num from (
  select run, op, num, part, part * 65535 - case when s and part = n - 1 then 1 else 0 end as lo, least((part + 1) * 65535, num) - case when s and part = n - 2 then 1 else 0 end as hi
  from (select *, (num + 65534) // 65535 as n, op = 'DUP' and num % 65535 = 1 and num > 1 as s, unnest(range((num + 65534) // 65535)) as part from ({_SPLIT_SQL})))"""


def _words16(s, d):
    rows = q._std_codes(s, d).where("op <> 'DONE'")
    px = P.to_rgb15(F.element_at("px", 1))
    shown = F.when(F.col("op") == "DUP", px).when((F.col("op") == "COPY") & ((F.pmod("start_idx", F.lit(2)) == 1) | (F.col("num") == 1)), px).otherwise(0)
    return rows.select("frame", "seq", "op", words.c4_16(F.col("op"), F.col("num"), shown.cast("long")).alias("word"))


# -- containers

def _header(s, d):
    return container.read_movies(s, files.movies(s, d)).select("movie", "version", "width", "height", "bpp", F.round(F.col("frame_duration").cast("double"), 6).alias("duration"), "num_frames", "all_keyframes")


_CADENCE = files.CADENCE


def _classes_sql(px: str) -> str:
    return q._classes(px, _CADENCE)


_HEADER_SQL = " union all ".join(
    f"select '{m}' as movie, 3 as version, 10 as width, 10 as height, {bpp} as bpp, round(cast(cast(1 as float) / cast(24 as float) as double), 6) as duration, cast(count(*) as int) as num_frames, bool_and(frame_class in ('key', 'nop')) as all_keyframes from ({_classes_sql(PX[m])})"
    for m, bpp in (("low.anim", 16), ("std.anim", 24), ("rgba.anim", 32))
)


def _folded(px: str) -> str:
    return q._FOLDED.replace(q.STD, px)


def _lengths(px: str) -> str:
    """frame, frame_class, length and adler of 32-bit payloads: a word a code and its pixels, DONE and a zero word."""
    return f"""{_folded(px)}, w as (select frame, cast(4 * (count(*) + sum(case op when 'DUP' then 1 when 'COPY' then num else 0 end) + 1) as bigint) as bytes from folded group by frame)
    select c.frame, c.frame_class, case c.frame_class when 'key' then 400 when 'delta' then w.bytes else 0 end as length, case when c.frame_class = 'nop' then 0 else a.adler end as adler
    from ({_classes_sql(px)}) c join ({q._adler(px, 400)}) a on c.frame = a.frame left join w on c.frame = w.frame"""


def _index_sql(px: str) -> str:
    return f"""with l as ({_lengths(px)}),
    g as (select *, sum(case when frame_class = 'key' then 1 else 0 end) over (order by frame) as gop, case frame_class when 'key' then (length + 16383) // 16384 * 16384 else length end as size, count(*) over () as n from l),
    p as (select *, sum(size) over (partition by gop order by frame) - size as within from g),
    t as (select gop, (sum(size) + 16383) // 16384 * 16384 as pages from g group by gop),
    b as (select gop, sum(pages) over (order by gop) - pages as start from t),
    o as (select frame, frame_class, length, adler, (64 + n * 24 + 16383) // 16384 * 16384 + start + within as offs from p join b on p.gop = b.gop),
    e as (select *, max(case when frame_class <> 'nop' then frame end) over (order by frame) as src from o)
    select cast(e.frame as int) as frame, cast(s.offs as bigint) as "offset", cast(s.length as bigint) as length, s.frame_class = 'key' as is_key, e.frame_class = 'nop' as is_nop, false as is_compressed, cast(e.adler as bigint) as adler
    from e join o s on e.src = s.frame"""


_INDEX_SQL = " union all ".join(f"select '{m}' as movie, * from ({_index_sql(PX[m])})" for m in ("std.anim", "rgba.anim"))
_ENTRY = ["movie", "frame", "offset", "length", "is_key", "is_nop", "is_compressed", "adler"]


def _index(s, d):
    return container.read_frames(s, files.movies(s, d)).where("movie <> 'low.anim'").select(*_ENTRY)


def _index_v2(s, d):
    """The index packed as version 2 entries and read again."""
    import pandas as pd

    rows = _index(s, d)

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples():
                data = container.pack_entry(int(r.offset), int(r.length), r.is_key * container.KEY + r.is_nop * container.NOP, int(r.adler), version=2)
                e = container.read_index(data, {"version": 2, "num_frames": 1 << 30}, int(r.frame))[0]
                out.append((r.movie, *e.values()))
            yield pd.DataFrame(out, columns=_ENTRY)

    return rows.mapInPandas(run, container.FRAMES)


def _payload(s, d, movie):
    data = container.read_frame_data(s, files.movies(s, d)).where((F.col("movie") == movie) & ~F.col("is_nop") & ~F.col("is_key"))
    return files.words_of(data, ["frame"])


def _payload32_sql(px: str) -> str:
    return f"""{_folded(px)}, dl as (select frame from ({_classes_sql(px)}) where frame_class = 'delta'),
    fo as (select folded.*, case op when 'DUP' then 1 when 'COPY' then num else 0 end as k from folded join dl on folded.frame = dl.frame),
    b as (select *, sum(1 + k) over (partition by frame order by seq) - 1 - k as base from fo),
    w as (select frame, base as pos, num * 1024 + case op when 'SKIP' then 0 when 'DUP' then 1 when 'COPY' then 2 else 3 end * 256 + skip_after as word from b
      union all select frame, base + 1, 0 from b where op = 'DONE'
      union all select b.frame, base + 1 + p.idx - start_idx, p.px from b join ({px}) p on b.frame = p.frame and k > 0 and p.idx >= start_idx and p.idx < start_idx + k)
    select cast(frame as int) as frame, cast(pos as bigint) as pos, cast(word as bigint) as word from w"""


_PAYLOAD16_SQL = f"""{q._CODES}, dl as (select frame from ({_classes_sql(LOW)}) where frame_class = 'delta'), low as ({LOW}),
    fo as (select codes.*, (op = 'COPY' and (start_idx % 2 = 1 or num = 1)) as one from codes join dl on codes.frame = dl.frame),
    k as (select *, case op when 'COPY' then (num - one::int + 1) // 2 else 0 end as pairs from fo),
    b as (select *, sum(1 + pairs) over (partition by frame order by seq) - 1 - pairs as base from k),
    w as (select b.frame, base as pos, case op when 'SKIP' then num when 'DONE' then 3221225472 when 'DUP' then 1073741824 + num * 65536 + p.px else 2147483648 + num * 65536 + case when one then p.px else 0 end end as word
        from b left join low p on b.frame = p.frame and b.start_idx = p.idx
      union all select b.frame, base + 1 + (p.idx - start_idx - one::int) // 2, sum(p.px * case when (p.idx - start_idx - one::int) % 2 = 0 then 1 else 65536 end)
        from b join low p on b.frame = p.frame and op = 'COPY' and p.idx >= start_idx + one::int and p.idx < start_idx + num group by 1, 2)
    select cast(frame as int) as frame, cast(pos as bigint) as pos, cast(word as bigint) as word from w"""


def _pixels(s, d):
    return container.read_pixels(s, files.movies(s, d)).select("movie", "frame", "idx", "px")


def _decode_data(s, d):
    got = container.decode(container.read_frame_data(s, files.movies(s, d)))
    return got.select("movie", F.col("frame").cast("long").alias("frame"), "bpp", "is_duplicate", F.octet_length("data").cast("long").alias("bytes"))


_BPP = {"low.anim": 16, "std.anim": 24, "rgba.anim": 32}


def _source(s, d):
    s.dataSource.register(container.AnimationSource)
    data = s.read.format("animation").option("table", "frame_data").option("bytesPerPartition", "65536").load(files.movies(s, d))
    return data.where("movie <> 'low.anim'").groupBy("movie").agg(F.count("*").alias("frames"), F.sum(F.octet_length("data")).alias("bytes"), F.count_if(F.expr("is_key and not is_nop")).alias("keys"))


_SOURCE_SQL = " union all ".join(
    f"select '{m}' as movie, count(*) as frames, cast(sum(length) as bigint) as bytes, count(*) filter (frame_class = 'key') as keys from ({_lengths(PX[m])})" for m in ("std.anim", "rgba.anim")
)


def _file_sizes(s, d):
    """What a folder shows after writing: whole files alone, each with its magic."""
    found = container.read_starts(s, files.movies(s, d), 4)
    return found.select(F.col("movie").alias("file"), F.hex("start").alias("magic"), (F.pmod("length", F.lit(4)) == 0).alias("aligned"))


def _upgraded(s, d):
    folder = files.once(s, d, "upgraded", lambda to: container.upgrade_movies(s, files.old_movie(s, d), to))
    frames = container.read_frames(s, folder)
    kind = F.when(F.col("is_nop"), "nop").when(F.col("is_key"), "key").otherwise("delta")
    version = container.read_movies(s, folder).select("version").scalar()
    return frames.select(F.col("frame").cast("long").alias("frame"), kind.alias("frame_class"), version.alias("version"))


def _upgraded_pixels(s, d):
    folder = files.once(s, d, "upgraded", lambda to: container.upgrade_movies(s, files.old_movie(s, d), to))
    return container.read_pixels(s, folder).select("frame", "idx", "px")


def _limits(s, d):
    """Which payload lengths an index entry of either version holds."""
    n = F.col("p_partkey").cast("long") * 167_772
    limit = lambda most: n <= most
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", limit(container.MAX_LENGTH_V2).alias("v2"), limit(container.MAX_LENGTH_V3).alias("v3"))


# -- sinks

def _pixel_dump(s, d):
    whole = container.decode_files(s, files.movies(s, d)).where("movie = 'std.anim'")
    return files.words_of(container.packed_pixels(whole, 10, 10), ["frame"])


def _pixel_dump16(s, d):
    whole = container.decode_files(s, files.movies(s, d)).where("movie = 'low.anim'")
    return files.words_of(container.packed_pixels(whole, 10, 10), ["frame"], 2)


def _code_dump(s, d):
    data = container.read_frame_data(s, files.movies(s, d)).where("movie = 'std.anim'")
    dump = container.packed_codes(data)
    return dump.select("frame", F.octet_length("data").cast("long").alias("bytes"), F.hex(F.substring("data", 9, 4)).alias("is_delta"))


def _pictures(s, d):
    def make(folder):
        images.write_pictures(container.decode_files(s, files.movies(s, d)).where("movie = 'rgba.anim'"), folder, 10, 10)

    return files.once(s, d, "pictures", make)


def _picture_pixels(s, d):
    got = images.decode_pictures(images.sequence_of(s, f"{_pictures(s, d)}/Frame0001.png"))
    return files.words_of(got, ["frame", "width", "height"]).select(F.col("frame").cast("long").alias("frame"), "width", "height", F.col("pos").alias("idx"), F.col("word").alias("px"))


def _picture_names(s, d):
    return s.read.format("binaryFile").load(_pictures(s, d)).select(F.element_at(F.split("path", "/"), -1).alias("name"))


def _flat(s, d):
    n = container.read_movies(s, files.movies(s, d)).where("movie = 'rgba.anim'").first().num_frames

    def make(folder):
        images.write_flat(container.decode_files(s, files.movies(s, d)).where("movie = 'rgba.anim'"), folder, 10, 10, 32, n)

    got = images.read_flat(s, files.once(s, d, "flat", make), 10, 10)
    return files.words_of(got, ["movie", "frame"]).select("movie", "frame", F.col("pos").alias("idx"), F.col("word").alias("px"))


def _lines(s, d):
    whole = container.decode_files(s, files.movies(s, d)).where("movie = 'rgba.anim'")
    frames = whole.select(F.col("frame").cast("long").alias("frame"), "is_duplicate")
    return images.in_order(images.text_lines(container.to_pixels(whole).drop("movie"), frames, "rgba.anim", 10, 32))


def _lines_std(s, d):
    """px_tiny has frames that repeat: a duplicate has its line alone."""
    px = fx.px_tiny(s, d)
    frames = delta.duplicate_flags(delta.frame_classes(px)).select("frame", "is_duplicate")
    return images.in_order(images.text_lines(px, frames, "tiny.anim", 2, 24))


def _lines_sql(px: str, name: str, bpp: int, width: int, classes: str) -> str:
    hexed = "printf('%08X', px)" if bpp == 32 else "printf('%06X', px)"
    rgb = "((px >> 16) & 255) || ', ' || ((px >> 8) & 255) || ', ' || (px & 255)"
    values = f"'RGBA = (' || {rgb} || ', ' || (px >> 24)" if bpp == 32 else f"'RGB = (' || {rgb}"
    return f"""with c as ({classes}), p as (select p.* from ({px}) p join c on p.frame = c.frame where frame_class <> 'nop')
    select cast(-1 as bigint) as frame, cast(-1 as bigint) as idx, 0 as part, 'File {name}, {bpp}BPP, ' || count(*) || ' FRAMES' as text from c
    union all select frame, -1, 0, 'FRAME ' || (frame + 1) || case when frame_class = 'nop' then ' (duplicate)' else '' end from c
    union all select frame, idx, 0, 'ROW ' || (idx // {width}) from p where idx % {width} = 0
    union all select frame, idx, 1, 'COLUMN ' || (idx % {width}) || ': HEX 0x' || {hexed} || ', ' || {values} || ')' from p"""


def _nop_rows(s, d):
    rows = fx.durations(s, d).withColumn("shown_us", F.pmod("dur_us", F.lit(400_000)))
    rows = timing.with_trailing_nops(rows, "shown_us", 41667)
    return rows.select("user_id", "event_id", "copy", "is_nop")


# -- QuickTime

def _mov_rows(s, d):
    got = quicktime.read_samples(s, files.quicktime(s, d))
    return got.select("movie", "sample", "chunk", "dur", "is_key", "width", "height", "bpp", "step")


def _mov_bytes(s, d):
    """Samples lie one after another from byte 8 on: each begins where the one before ends."""
    got = quicktime.read_samples(s, files.quicktime(s, d)).select("movie", "sample", "size", "file_offset")
    ends = got.select("movie", (F.col("sample") + 1).alias("sample"), (F.col("file_offset") + F.col("size")).alias("end"))
    return got.join(ends, ["movie", "sample"], "left").select("movie", "sample", (F.col("file_offset") == F.coalesce("end", F.lit(8).cast("long"))).alias("follows"))


def _mov_pixels(s, d):
    whole = quicktime.decode_files(s, files.quicktime(s, d))
    px = container.to_pixels(whole.where("not is_duplicate"))
    order = whole.select("movie", "frame", "is_duplicate")
    return px.join(order, ["movie", "frame"]).select("movie", "frame", "idx", "px")


def _mov_duplicates(s, d):
    return quicktime.decode_files(s, files.quicktime(s, d)).select("movie", F.col("frame").cast("long").alias("frame"), "bpp", "is_duplicate")


_MOV = {"low.mov": (LOW, 16), "std.mov": (q.STD, 24), "rgba.mov": (q.RGBA, 32)}
_N = "(select count(*) // 100 from orders)"
_MOV_ROWS_SQL = " union all ".join(
    f"select '{m}' as movie, i as sample, i // 4 as chunk, cast(case when i % 5 = 4 then 40 else 20 end as bigint) as dur, i % {_CADENCE} = 0 as is_key, 10 as width, 10 as height, {bpp} as bpp, cast(20 as bigint) as step from range(0, {_N}) t(i)"
    for m, (_, bpp) in _MOV.items()
)
_MOV_BYTES_SQL = " union all ".join(f"select '{m}' as movie, i as sample, true as follows from range(0, {_N}) t(i)" for m in _MOV)
_MOV_PIXELS_SQL = " union all ".join(f"select '{m}' as movie, frame + frame // 5 as frame, idx, px from ({px})" for m, (px, _) in _MOV.items())
_MOV_DUPLICATES_SQL = " union all ".join(
    f"select '{m}' as movie, i + i // 5 + k as frame, {bpp} as bpp, k = 1 as is_duplicate from range(0, {_N}) t(i), range(0, 2) u(k) where k = 0 or i % 5 = 4" for m, (_, bpp) in _MOV.items()
)


# -- streams

def _stream(s, d, name: str, make):
    """Run a stream over the files that `make` wrote until all are read; the result as a table."""
    out = _new(s, f"stream-{name}")
    stream = make()
    run = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return s.read.schema(stream.schema).parquet(f"{out}/rows")


def _stored(s, d, name: str, rows, parts: int):
    """rows as `parts` Parquet files of consecutive frames, by time of writing."""

    def make(folder):
        n = rows.agg(F.max("frame")).first()[0] + 1
        for k in range(parts):
            part = rows.where((F.col("frame") >= n * k // parts) & (F.col("frame") < n * (k + 1) // parts))
            part.coalesce(1).write.mode("append").parquet(f"{folder}/rows")

    folder = files.once(s, d, name, make)
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/rows")


def _whole(s, d):
    px, bpp = files.px_of(s, d, "std.anim")
    return container.whole_frames(px.where("frame < 40"), bpp)


def _stream_encode(s, d):
    got = _stream(s, d, "encode", lambda: streaming.encode_stream(_stored(s, d, "whole", _whole(s, d), 3), 24, _CADENCE))
    return got.select("movie", "frame", "frame_class", F.octet_length("data").cast("long").alias("length"), "adler")


def _stream_decode(s, d):
    rows = container.read_frame_data(s, files.movies(s, d)).where("movie = 'std.anim' and frame < 40").withColumn("frame", F.col("frame").cast("long"))
    rows = rows.select("movie", "frame", "is_key", "is_nop", "width", "height", "bpp", "data")
    got = _stream(s, d, "decode", lambda: streaming.decode_stream(_stored(s, d, "payloads", rows, 3)))
    return files.words_of(got, ["movie", "frame", "is_duplicate"]).select("movie", "frame", "is_duplicate", F.col("pos").alias("idx"), F.col("word").alias("px"))


# -- pixels and reports

def _adler16(s, d):
    """99 pixels of 16 bits: one zero pixel more is summed."""
    px, _ = files.px_of(s, d, "low.anim")
    return aggregate.frame_adler(px.drop("movie").where("idx < 99"), 99, 16)


_ADLER16_SQL = f"""select frame, cast(case when s = 0 then 4294967295 else s end as bigint) as adler from (select frame,
  cast(sum((200 - idx * 2) * (px & 255) + (200 - idx * 2 - 1) * (px >> 8)) % 65521 * 65536 + sum((px & 255) + (px >> 8)) % 65521 as bigint) as s from ({LOW}) where idx < 99 group by frame)"""


def _wrong_checksums(s, d):
    stored = q._stored_adler(s, d).withColumn("adler", F.when((F.pmod("frame", F.lit(5)) == 0) & (F.col("adler") != 0), F.col("adler") + 1).otherwise(F.col("adler")))
    return aggregate.checksum_mismatches(stored, aggregate.frame_adler(q._decoded(s, d), 2))


def _keyframes(s, d):
    rows = None
    for every in (1, _CADENCE):
        part = aggregate.all_keyframes(delta.frame_classes(fx.px_std(s, d), every)).select(F.lit(every).alias("every"), "all_keyframes")
        rows = part if rows is None else rows.union(part)
    return rows


def _probes(s, d):
    one, two = (aggregate.any_translucent(px).select(F.lit(n).alias("movie"), "has_alpha", "bpp") for n, px in (("std", fx.px_std(s, d).withColumn("px", F.col("px") + 0xFF000000)), ("rgba", fx.px_rgba(s, d))))
    return one.union(two)


def _specs(s, d):
    k = F.col("p_partkey")
    text = [F.concat(k.cast("string"), F.lit(" / 1 ")), F.pmod(k, F.lit(120)).cast("string"), F.lit("0"), F.lit("fast"), F.concat(F.lit("0/"), k.cast("string")), F.concat(F.lit("30000/"), F.lit("1001")), F.lit("-24"), F.lit("24.5")]
    spec = F.element_at(F.array(*text), (F.pmod(k, F.lit(8)) + 1).cast("int"))
    rows = s.read.parquet(f"{d}/part.parquet").select("p_partkey", spec.alias("spec"))
    return rows.select("p_partkey", "spec", timing.parse_fps(F.col("spec")).cast("double").alias("duration"), timing.parse_frame_duration(F.col("spec")).cast("double").alias("as_duration"))


_SPECS_SQL = """select p_partkey, spec, case when strpos(clean, '/') > 0 then cast(case when cast(split_part(clean, '/', 1) as float) <> 0 then cast(cast(split_part(clean, '/', 2) as float) / cast(split_part(clean, '/', 1) as float) as float) end as double)
    when try_cast(clean as float) > 0 and try_cast(clean as float) < 90 then cast(cast(cast(1 as float) / try_cast(clean as float) as float) as double) end as duration,
    case when strpos(spec, '/') = 0 and try_cast(spec as float) > 0 and try_cast(spec as float) < 90 then cast(try_cast(spec as float) as double) end as as_duration
  from (select p_partkey, spec, replace(spec, ' ', '') as clean from (select p_partkey, case p_partkey % 8 when 0 then p_partkey || ' / 1 ' when 1 then cast(p_partkey % 120 as varchar) when 2 then '0' when 3 then 'fast' when 4 then '0/' || p_partkey
    when 5 then '30000/1001' when 6 then '-24' else '24.5' end as spec from part))"""


def _shapes(s, d):
    heads = fx.movies(s, d)
    rows = None
    for a, b in (("std", "rgba"), ("std", "tiny"), ("std", "std")):
        part = combine.shape_mismatches(heads.where(F.col("movie") == a), heads.where(F.col("movie") == b)).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "field", "first", "second")
        rows = part if rows is None else rows.union(part)
    return rows


_SHAPES_SQL = """with m as (select movie, cast(width as double) as width, cast(height as double) as height, cast(bpp as double) as bpp, cast((select count(*) from orders) // size as double) as num_frames
    from (values ('std', 10, 10, 24, 100), ('tiny', 2, 1, 24, 2), ('rgba', 10, 10, 32, 100)) t(movie, width, height, bpp, size)),
  u as (unpivot m on width, height, bpp, num_frames into name field value v)
  select x.movie as a, y.movie as b, x.field, x.v as first, y.v as second from u x join u y on x.field = y.field where x.movie = 'std' and x.v <> y.v"""


def _join_alpha(s, d):
    """Colours of one movie with the alpha of another: no round trip."""
    return combine.join_alpha(fx.px_std(s, d), combine.split_alpha(fx.px_rgba(s, d)))


def _unmix(s, d):
    return combine.unmix_alpha(combine.mix_straight(fx.px_std(s, d), combine.split_alpha(fx.px_rgba(s, d))))


def _unflatten(s, d):
    px = F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).cast("long")
    return spatial.unflatten(fx.orders(s, d).select(F.col("o_orderkey").alias("flat_idx"), px.alias("px")), 100)


_OVER = f"""select s.frame, s.idx, cast(a * 16777216 + (a * ((s.px >> 16) & 255)) // 255 * 65536 + (a * ((s.px >> 8) & 255)) // 255 * 256 + (a * (s.px & 255)) // 255 as bigint) as px
  from ({q.STD}) s join ({q._PARTS} from ({q.RGBA})) m on s.frame = m.frame and s.idx = m.idx"""


def _clear(s, d):
    return fx.px_std(s, d).select("frame", "idx", P.clear(F.col("px")).alias("px"))


def _steps(s, d):
    """A track whose least duration is 1 isn't valid."""
    rows = None
    for name, cut in (("good", 0), ("bad", 1)):
        samples = fx.mov_samples(s, d).withColumn("movie", F.lit(name)).withColumn("dur", F.col("dur") - F.when(F.pmod("sample", F.lit(9)) == 0, cut).otherwise(0))
        part = movtables.frame_step(samples)
        rows = part if rows is None else rows.union(part)
    return rows


QUERIES = {
    "run_splits": _run_splits,
    "words_generic16": _generic_words,
    "c4_word16_pack": _words16,
    "container_header": _header,
    "container_index": _index,
    "container_index_v2": _index_v2,
    "container_payload32": lambda s, d: _payload(s, d, "std.anim"),
    "container_payload16": lambda s, d: _payload(s, d, "low.anim"),
    "container_pixels": _pixels,
    "container_decode": _decode_data,
    "container_source": _source,
    "container_files": _file_sizes,
    "container_upgrade": _upgraded,
    "container_upgrade_pixels": _upgraded_pixels,
    "container_limits": _limits,
    "sink_pixels": _pixel_dump,
    "sink_pixels16": _pixel_dump16,
    "sink_codes": _code_dump,
    "sink_pictures": _picture_names,
    "source_pictures": _picture_pixels,
    "flat_picture": _flat,
    "sink_text": _lines,
    "sink_text_duplicates": _lines_std,
    "trailing_nop_rows": _nop_rows,
    "mov_file_samples": _mov_rows,
    "mov_file_offsets": _mov_bytes,
    "mov_file_pixels": _mov_pixels,
    "mov_file_duplicates": _mov_duplicates,
    "stream_encode": _stream_encode,
    "stream_decode": _stream_decode,
    "frame_adler16": _adler16,
    "frame_adler_wrong": _wrong_checksums,
    "all_keyframes_both": _keyframes,
    "px_opaque_probe_both": _probes,
    "fps_parse_odd": _specs,
    "shape_mismatch": _shapes,
    "joinalpha_other": _join_alpha,
    "unmixalpha_other": _unmix,
    "unflatten_other": _unflatten,
    "px_clear": _clear,
    "mov_frame_step_valid": _steps,
}

_TINY_CLASSES = q._classes(q.TINY, 10000)
_WHOLE_SQL = f"select * from ({_lengths(q.STD)}) where frame < 40"

ORACLE = {
    "run_splits": _PARTS_SQL,
    "words_generic16": f"select run, part, word, (word >> 30) & 3 as op, word & 65535 as num, (word >> 16) & 16383 as value from (select run, part, cast(case op when 'SKIP' then 0 when 'DUP' then 1 else 2 end * cast(1073741824 as bigint) + run % 4 * 65536 + num as bigint) as word from ({_PARTS_SQL}))",
    "c4_word16_pack": f"""{q._CODES}, low as ({LOW}) select c.frame, seq, op, cast(case op when 'SKIP' then num when 'DUP' then 1073741824 + num * 65536 + p.px else 2147483648 + num * 65536 + case when start_idx % 2 = 1 or num = 1 then p.px else 0 end end as bigint) as word
      from codes c left join low p on c.frame = p.frame and c.start_idx = p.idx where op <> 'DONE'""",
    "container_header": _HEADER_SQL,
    "container_index": _INDEX_SQL,
    "container_index_v2": _INDEX_SQL,
    "container_payload32": _payload32_sql(q.STD),
    "container_payload16": _PAYLOAD16_SQL,
    "container_pixels": _with_movie(lambda m, px: f"select frame, idx, px from ({px})"),
    "container_decode": " union all ".join(f"select '{m}' as movie, frame, {_BPP[m]} as bpp, frame_class = 'nop' as is_duplicate, cast({200 if _BPP[m] == 16 else 400} as bigint) as bytes from ({_classes_sql(px)})" for m, px in PX.items()),
    "container_source": _SOURCE_SQL,
    "container_files": "select unnest(['low.anim', 'std.anim', 'rgba.anim']) as file, 'BEBAFECA' as magic, true as aligned",
    "container_upgrade": f"select frame, frame_class, 3 as version from ({q._classes(q.STD, 10000)})",
    "container_upgrade_pixels": q.STD,
    "container_limits": "select p_partkey, p_partkey * 167772 <= 16777215 as v2, p_partkey * 167772 <= 4294967295 as v3 from part",
    "sink_pixels": f"select cast(frame as int) as frame, idx + 2 as pos, px as word from ({q.STD}) union all select cast(frame as int), unnest([0, 1]), 10 from ({q.STD}) where idx = 0",
    "sink_pixels16": f"select cast(frame as int) as frame, idx + 4 as pos, px as word from ({LOW}) union all select cast(frame as int), unnest([0, 1, 2, 3]), unnest([10, 0, 10, 0]) from ({LOW}) where idx = 0",
    "sink_codes": f"select cast(frame as int) as frame, cast(case frame_class when 'nop' then 0 else 12 + length end as bigint) as bytes, case frame_class when 'nop' then '' when 'key' then '00000000' else '01000000' end as is_delta from ({_lengths(q.STD)})",
    "sink_pictures": f"select printf('Frame%04d.png', i + 1) as name from range(0, {_N}) t(i)",
    "source_pictures": f"select frame, 10 as width, 10 as height, idx, px from ({q.RGBA})",
    "flat_picture": f"select 'rgba.anim' as movie, frame, idx, px from ({q.RGBA})",
    "sink_text": _lines_sql(q.RGBA, "rgba.anim", 32, 10, q._classes(q.RGBA, _CADENCE)),
    "sink_text_duplicates": _lines_sql(q.TINY, "tiny.anim", 24, 2, _TINY_CLASSES),
    "trailing_nop_rows": f"select user_id, event_id, unnest(range(0, n + 1)) as copy, unnest(range(0, n + 1)) > 0 as is_nop from (select *, greatest((2 * (dur_us % 400000) + 41667) // (2 * 41667) - 1, 0) as n from ({q.ORACLE['trailing_nops']}))",
    "mov_file_samples": _MOV_ROWS_SQL,
    "mov_file_offsets": _MOV_BYTES_SQL,
    "mov_file_pixels": _MOV_PIXELS_SQL,
    "mov_file_duplicates": _MOV_DUPLICATES_SQL,
    "stream_encode": f"select 'std.anim' as movie, frame, frame_class, cast(length as bigint) as length, cast(adler as bigint) as adler from ({_WHOLE_SQL})",
    "stream_decode": f"select 'std.anim' as movie, p.frame, c.frame_class = 'nop' as is_duplicate, idx, px from ({q.STD}) p join ({_classes_sql(q.STD)}) c on p.frame = c.frame where p.frame < 40",
    "frame_adler16": _ADLER16_SQL,
    "frame_adler_wrong": f"select s.frame, s.adler + 1 as stored, c.adler as computed from ({q._STORED}) s join ({q._adler(q.TINY, 8)}) c on s.frame = c.frame where s.adler <> 0 and s.frame % 5 = 0",
    "all_keyframes_both": f"select 1 as every, bool_and(frame_class in ('key', 'nop')) as all_keyframes from ({q._classes(q.STD, 1)}) union all select {_CADENCE}, bool_and(frame_class in ('key', 'nop')) from ({_classes_sql(q.STD)})",
    "px_opaque_probe_both": f"select 'std' as movie, false as has_alpha, 24 as bpp union all select 'rgba', bool_or(px >> 24 <> 255), case when bool_or(px >> 24 <> 255) then 32 else 24 end from ({q.RGBA})",
    "fps_parse_odd": _SPECS_SQL,
    "shape_mismatch": _SHAPES_SQL,
    "joinalpha_other": _OVER,
    "unmixalpha_other": _OVER,
    "unflatten_other": "select o_orderkey // 100 as frame, o_orderkey % 100 as idx, cast(case when o_orderstatus = 'F' then 1 else 2 end as bigint) as px from orders",
    "px_clear": f"select frame, idx, cast(0 as bigint) as px from ({q.STD})",
    "mov_frame_step_valid": f"""select movie, min(case when d > 0 then d end) as smallest, cast(sum(d) as bigint) as total, max(size) as largest_size, min(case when d > 0 then d end) <> 1 as valid
      from (select *, dur - case when movie = 'bad' and sample % 9 = 0 then 1 else 0 end as d from ({q.MOV}), (select unnest(['good', 'bad']) as movie)) group by movie""",
}
