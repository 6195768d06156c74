"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import pixels as P
from .functions import timing
from .operators import aggregate, combine, delta, movtables, spatial
from .plans import fixtures as fx

W, H, N = 10, 10, 100  # the 10 x 10 fixtures


def _codes_word32(op, num, skip):
    """A 32-bit code word: number, op and skip."""
    code = F.when(op == "SKIP", 0).when(op == "DUP", 1).when(op == "COPY", 2).otherwise(3)
    return (num * 1024 + code * 256 + skip).cast("long")


def _std_codes(s, d):
    return delta.codes(delta.delta_pixels(fx.px_std(s, d)), N)


def _words(s, d):
    folded = delta.fold_skips(_std_codes(s, d))
    return folded.select("frame", "seq", "op", _codes_word32(F.col("op"), F.col("num"), F.col("skip_after")).alias("word"))


def _stored_adler(s, d):
    """The index of px_tiny as an encoder writes it: a nop stores no checksum."""
    frames = delta.frame_classes(fx.px_tiny(s, d)).join(aggregate.frame_adler(fx.px_tiny(s, d), 2), "frame")
    nop = F.col("frame_class") == "nop"
    return frames.select("frame", nop.alias("is_nop"), F.when(nop, 0).otherwise(F.col("adler")).cast("long").alias("adler"))


def _decoded(s, d):
    px = fx.px_tiny(s, d)
    return delta.decode_fill(delta.keyframe_and_delta_rows(px), px.select("frame").distinct(), 2)


def _components(s, d):
    px = F.col("px")
    return fx.px_rgba(s, d).select("frame", "idx", P.alpha(px).alias("a"), P.red(px).alias("r"), P.green(px).alias("g"), P.blue(px).alias("b"))


def _components16(s, d):
    px = P.to_rgb15(F.col("px"))
    return fx.px_std(s, d).select("frame", "idx", px.alias("px16"), P.red(px, 16).alias("r"), P.green(px, 16).alias("g"), P.blue(px, 16).alias("b"))


def _bytewise(s, d):
    diff = delta.with_previous(fx.px_std(s, d)).where("old_px is not null").select("frame", "idx", "old_px", P.subtract(F.col("px"), F.col("old_px")).alias("delta"))
    return diff.select("frame", "idx", "delta", P.add(F.col("old_px"), F.col("delta")).alias("px"))


def _info(s, d):
    frame = F.col("frame_duration").cast("double")
    return fx.movies(s, d).select(
        "movie", "version", "width", "height", "bpp", F.lit("sRGB").alias("colorspace"), F.format_string("%.4f", frame).alias("frame_duration"), timing.fps_label(F.col("frame_duration")).alias("fps"), "num_frames", "all_keyframes",
        F.round(frame * F.col("num_frames"), 3).alias("duration"), (F.col("bpp") == 32).alias("has_alpha"),
    )


def _parse_fps(s, d):
    part = s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat("p_size", F.lit("/1")).alias("spec"))
    return part.select("p_partkey", "spec", timing.parse_fps(F.col("spec")).cast("double").alias("duration"))


def _names(s, d):
    name = F.concat("movie", F.lit(".anim"))
    return fx.movies(s, d).select("movie", *[timing.suffixed(name, x).alias(f"name{x}") for x in ("_rgb", "_alpha", "_mix", "_q1")])


def _offsets(s, d):
    return movtables.sample_offsets(fx.mov_samples(s, d)).select("sample", "file_offset")


def _chunks(s, d):
    chunks = fx.mov_samples(s, d).select("chunk").distinct()
    firsts = chunks.where("chunk % 10 = 0").select(F.col("chunk").alias("first_chunk"), (F.pmod("chunk", F.lit(7)) + 1).alias("samples_per_chunk"))
    return movtables.chunk_counts(chunks, firsts)


def _sync(s, d):
    samples = fx.mov_samples(s, d)
    return movtables.sync_flags(samples, samples.where("sample % 12 = 0").select((F.col("sample") + 1).alias("sample_id"))).select("sample", "is_key")


def _nops(s, d):
    return fx.durations(s, d).select("user_id", "event_id", "dur_us", timing.trailing_nops(F.col("dur_us"), 41667).alias("nops"))


def _emb_adler(s, d):
    return aggregate.frame_adler(fx.px_emb(s, d).select("frame", F.posexplode("px").alias("idx", "px")), 64)


def _resize(s, d):
    return spatial.resize_nearest(fx.px_std(s, d), W, H, 7, 13)


def _overlay(s, d):
    return combine.overlay(fx.px_std(s, d), fx.px_mod(s, d))


def _rgba_round_trip(s, d):
    px = fx.px_rgba(s, d)
    return combine.join_alpha(combine.split_rgb(px), combine.split_alpha(px))


QUERIES = {
    "frame_class": lambda s, d: delta.frame_classes(fx.px_tiny(s, d)),
    "frame_delta": lambda s, d: delta.delta_pixels(fx.px_std(s, d)),
    "frame_keyframe_cadence": lambda s, d: delta.frame_classes(fx.px_std(s, d), 12).select("frame", "frame_class"),
    "px_components": _components,
    "px_components16": _components16,
    "px_premultiply": lambda s, d: fx.px_std(s, d).select("frame", "idx", P.premultiply(F.col("px") + F.pmod("idx", F.lit(256)) * 16777216).alias("px")),
    "px_unpremultiply": lambda s, d: fx.px_rgba(s, d).select("frame", "idx", P.unpremultiply(F.col("px")).alias("px")),
    "px_bytewise_delta": _bytewise,
    "px_swap": lambda s, d: fx.px_rgba(s, d).select("frame", "idx", P.swap_red_blue(F.col("px")).alias("px")),
    "px_text": lambda s, d: fx.px_rgba(s, d).select("frame", "idx", P.hex_word(F.col("px"), 32).alias("hex")),
    "px_histogram": lambda s, d: aggregate.histogram(fx.px_rgba(s, d)),
    "px_histogram_rgb": lambda s, d: aggregate.by_frequency(aggregate.histogram(fx.px_rgba(s, d), 0xFFFFFF)),
    "px_opaque_probe": lambda s, d: aggregate.any_translucent(fx.px_rgba(s, d)),
    "frame_adler": lambda s, d: aggregate.frame_adler(fx.px_std(s, d), N),
    "frame_adler_wide": _emb_adler,
    "frame_adler_nopfill": lambda s, d: aggregate.adler_with_nops(_stored_adler(s, d)),
    "frame_adler_check": lambda s, d: aggregate.checksum_mismatches(_stored_adler(s, d), aggregate.frame_adler(_decoded(s, d), 2)),
    "frame_duplicates": lambda s, d: delta.duplicate_flags(delta.frame_classes(fx.px_tiny(s, d))).select("frame", "is_duplicate"),
    "all_keyframes": lambda s, d: aggregate.all_keyframes(delta.frame_classes(fx.px_tiny(s, d), 1)),
    "delta_islands": lambda s, d: delta.islands(delta.delta_pixels(fx.px_std(s, d))),
    "delta_runs": lambda s, d: delta.runs(delta.delta_pixels(fx.px_std(s, d))).select("frame", "start_idx", "num", "op", F.array_join("px", ",").alias("px")),
    "delta_codes": lambda s, d: _std_codes(s, d).select("frame", "seq", "op", "start_idx", "num"),
    "codes_skip_after": lambda s, d: delta.fold_skips(_std_codes(s, d)).select("frame", "seq", "op", "start_idx", "num", "skip_after"),
    "c4_word32_pack": _words,
    "decode_forward_fill": _decoded,
    "gop_seek": lambda s, d: delta.gops(delta.frame_classes(fx.px_std(s, d), 12).select("frame", "frame_class")),
    "gop_seek_start": lambda s, d: delta.seek_start(delta.frame_classes(fx.px_std(s, d), 12), 10),
    "crop": lambda s, d: spatial.crop(fx.px_std(s, d), W, H, 2, 3, 5, 4),
    "fourup": lambda s, d: spatial.four_up(fx.px_std(s, d), W, H),
    "resize_double": lambda s, d: spatial.double(fx.px_std(s, d), W),
    "resize_half_box": lambda s, d: spatial.half_box(fx.px_std(s, d), W, H),
    "resize_nearest": _resize,
    "flatten": lambda s, d: spatial.flatten(fx.px_std(s, d), N),
    "unflatten": lambda s, d: spatial.unflatten(spatial.flatten(fx.px_std(s, d), N), N),
    "alphamap": lambda s, d: combine.alpha_map(fx.px_rgba(s, d), "252=255,254=255,1=0,7=7").select("frame", "idx", "px"),
    "alphamap_count": lambda s, d: combine.alpha_map(fx.px_rgba(s, d), "252=255,254=255,1=0,7=7").agg(F.count_if("is_hit").alias("modified")),
    "splitalpha_rgb": lambda s, d: combine.split_rgb(fx.px_rgba(s, d)),
    "splitalpha_alpha": lambda s, d: combine.split_alpha(fx.px_rgba(s, d)),
    "joinalpha": _rgba_round_trip,
    "mixalpha": lambda s, d: combine.mix_alpha(fx.px_rgba(s, d)),
    "unmixalpha": lambda s, d: combine.unmix_alpha(combine.mix_alpha(fx.px_rgba(s, d))),
    "mixstraight": lambda s, d: combine.mix_straight(fx.px_std(s, d), fx.px_mod(s, d)),
    "rdelta_mask": lambda s, d: combine.differing(fx.px_std(s, d), fx.px_mod(s, d)),
    "rdelta_count": lambda s, d: combine.differing(fx.px_std(s, d), fx.px_mod(s, d)).agg(F.count("*").alias("modified")),
    "rdelta_overlay": _overlay,
    "fps_label": lambda s, d: fx.fps_in(s, d).select("p_partkey", timing.fps_label(F.col("frame_duration")).alias("label")),
    "fps_parse": _parse_fps,
    "trailing_nops": _nops,
    "movie_info": _info,
    "movie_names": _names,
    "mov_frame_to_sample": lambda s, d: movtables.frame_to_sample(fx.mov_samples(s, d), 2),
    "mov_start_times": lambda s, d: movtables.start_times(fx.mov_samples(s, d)).select("sample", "start_time"),
    "mov_frame_step": lambda s, d: movtables.frame_step(fx.mov_samples(s, d)),
    "mov_chunk_asof": _chunks,
    "mov_sample_offset": _offsets,
    "mov_sync_flag": _sync,
}


# The SQL of the fixtures. `//` is integer division here.
def _frames(key: str, size: int, table: str = "orders") -> str:
    return f"{key} // {size} as frame, {key} % {size} as idx", f"from {table} where {key} // {size} < (select count(*) // {size} from {table})"


_PX = "cast(case o_orderstatus when 'F' then 16711680 when 'O' then 65280 else 255 end as bigint)"


def _px_sql(size: int, px: str = _PX) -> str:
    cols, rows = _frames("o_orderkey", size)
    return f"select {cols}, {px} as px {rows}"


STD, TINY = _px_sql(100), _px_sql(2)
MOD = _px_sql(100, f"case when o_orderkey % 17 = 0 then 0 else {_PX} end")
_A = "(o_custkey % 256)"
RGBA = _px_sql(100, f"cast({_A} * 16777216 + ({_A} * ((o_orderkey * 37) % 256)) // 255 * 65536 + ({_A} * ((o_orderkey * 101) % 256)) // 255 * 256 + ({_A} * ((o_orderkey * 13) % 256)) // 255 as bigint)")
MOV = "select event_id as sample, event_id // 4 as chunk, 1 + (event_id * 7919) % 4096 as size, 2 + 2 * (event_id % 3) as dur from events"


def _un(c: str) -> str:
    u = f"least(255, {c} * 255 // nullif(a, 0))"
    return f"case when a * {u} // 255 < {c} then least({u} + 1, 255) when a * {u} // 255 > {c} then greatest({u} - 1, 0) else {u} end"


_PARTS = "select frame, idx, px, px >> 24 as a, (px >> 16) & 255 as r, (px >> 8) & 255 as g, px & 255 as b"
_UNPX = f"case when a = 0 then 0 when a = 255 then px else cast(a * 16777216 + ({_un('r')}) * 65536 + ({_un('g')}) * 256 + ({_un('b')}) as bigint) end"


def _classes(px: str, every: int) -> str:
    return f"""select frame, count(*) as n_px, count(*) filter (old <> px) as n_changed,
    case when frame = 0 or frame % {every} = 0 or count(*) filter (old <> px) = count(*) then 'key' when count(*) filter (old <> px) = 0 then 'nop' else 'delta' end as frame_class
    from (select *, lag(px) over (partition by idx order by frame) as old from ({px})) group by frame"""


def _adler(px: str, n: int) -> str:
    b = [f"((px >> {8 * k}) & 255)" for k in range(4)]
    s1, s2 = " + ".join(b), " + ".join(f"({n} - idx * 4 - {k}) * {x}" for k, x in enumerate(b))
    return f"""select frame, cast(case when s = 0 then 4294967295 else s end as bigint) as adler
    from (select frame, cast(sum({s2}) % 65521 * 65536 + sum({s1}) % 65521 as bigint) as s from ({px}) group by frame)"""


_DELTA = f"select frame, idx, old as old_px, px as new_px from (select *, lag(px) over (partition by idx order by frame) as old from ({STD})) where old <> px"
_RUNS = f"""with d as ({_DELTA}), i as (select *, idx - row_number() over (partition by frame order by idx) as isl from d),
f as (select *, case when lag(new_px) over (partition by frame, isl order by idx) = new_px then 0 else 1 end as first from i),
r as (select *, sum(first) over (partition by frame, isl order by idx) as run from f),
c as (select *, count(*) over (partition by frame, isl, run) >= 2 as dup from r),
p as (select *, case when dup then run else -1 - sum(case when dup then 1 else 0 end) over (partition by frame, isl order by idx) end as piece from c),
runs as (select frame, min(idx) as start_idx, count(*) as num, case when dup then 'DUP' else 'COPY' end as op,
  case when dup then cast(min(new_px) as varchar) else string_agg(cast(new_px as varchar), ',' order by idx) end as px from p group by frame, isl, piece, dup)"""
_CODES = f"""{_RUNS}, g as (select *, coalesce(lag(start_idx + num) over w, 0) as prev, lead(start_idx) over w as nxt from runs window w as (partition by frame order by start_idx)),
rows as (select frame, 'SKIP' as op, prev as start_idx, start_idx - prev as num from g where start_idx > prev
  union all select frame, op, start_idx, num from g
  union all select frame, 'SKIP', start_idx + num, 100 - start_idx - num from g where nxt is null and start_idx + num < 100
  union all select frame, 'DONE', 100, 0 from g where nxt is null),
codes as (select frame, row_number() over (partition by frame order by start_idx, op = 'DONE') as seq, op, cast(start_idx as bigint) as start_idx, cast(num as bigint) as num from rows)"""
_FOLDED = f"""{_CODES}, n as (select *, case when lead(op) over w = 'SKIP' then lead(num) over w else 0 end as nxt_skip, coalesce(lag(op) over w in ('DUP', 'COPY'), false) as after from codes window w as (partition by frame order by seq)),
cut as (select *, case when op = 'SKIP' and after then least(num, 255) else 0 end as cut from n),
folded as (select frame, row_number() over (partition by frame order by seq) as seq, op, start_idx + cut as start_idx, num - cut as num, cast(case when op in ('DUP', 'COPY') then least(nxt_skip, 255) else 0 end as bigint) as skip_after from cut where op <> 'SKIP' or num > cut)"""
_STORED = f"select c.frame, frame_class = 'nop' as is_nop, case when frame_class = 'nop' then 0 else adler end as adler from ({_classes(TINY, 10000)}) c join ({_adler(TINY, 8)}) a on c.frame = a.frame"
_MAP = "case a when 252 then 255 when 254 then 255 when 1 then 0 when 7 then 7 end"
_D = "cast(cast(1 as float) / cast(p_size as float) as float)"
_LABEL = (
    "case "
    + " ".join(f"when abs(cast(cast({v!r} as float) as double) - cast(d as double)) <= cast(cast(0.0001 as float) as double) then '{n}'" for n, v in timing.LABELS)
    + " else (select min(i) from range(0, 1200) t(i) where cast(cast(0.001 as float) * cast(i as float) as double) >= cast(d as double)) || '/1000' end"
)

ORACLE = {
    "frame_class": _classes(TINY, 10000),
    "frame_delta": _DELTA,
    "frame_keyframe_cadence": f"select frame, frame_class from ({_classes(STD, 12)})",
    "px_components": f"select frame, idx, a, r, g, b from ({_PARTS} from ({RGBA}))",
    "px_components16": f"select frame, idx, px16, px16 >> 10 as r, (px16 >> 5) & 31 as g, px16 & 31 as b from (select frame, idx, ((px >> 19) & 31) * 1024 + ((px >> 11) & 31) * 32 + ((px >> 3) & 31) as px16 from ({STD}))",
    "px_premultiply": f"select frame, idx, cast(idx * 16777216 + (idx * r) // 255 * 65536 + (idx * g) // 255 * 256 + (idx * b) // 255 as bigint) as px from ({_PARTS} from ({STD}))",
    "px_unpremultiply": f"select frame, idx, {_UNPX} as px from ({_PARTS} from ({RGBA}))",
    "px_bytewise_delta": f"""select frame, idx, cast(sum((((px >> s) & 255) - ((old >> s) & 255) + 256) % 256 * (1 << s)) as bigint) as delta, any_value(px) as px
      from (select *, lag(px) over (partition by idx order by frame) as old from ({STD})), (select unnest([0, 8, 16, 24]) as s) where old is not null group by frame, idx""",
    "px_swap": f"select frame, idx, a * 16777216 + b * 65536 + g * 256 + r as px from ({_PARTS} from ({RGBA}))",
    "px_text": f"select frame, idx, printf('%08X', px) as hex from ({RGBA})",
    "px_histogram": f'select px, count(*) as "count" from ({RGBA}) group by px',
    "px_histogram_rgb": f'select px & 16777215 as px, count(*) as "count" from ({RGBA}) group by 1',
    "px_opaque_probe": f"select bool_or(px >> 24 <> 255) as has_alpha, case when bool_or(px >> 24 <> 255) then 32 else 24 end as bpp from ({RGBA})",
    "frame_adler": _adler(STD, 400),
    "frame_adler_wide": _adler("select vec_id as frame, i - 1 as idx, cast(least(greatest(floor(embedding[i] * 128) + 128, 0), 255) as bigint) * 65793 as px from (select vec_id, embedding, unnest(range(1, 65)) as i from embeddings)", 256),
    "frame_adler_nopfill": f"select frame, is_nop, adler, '0x' || printf('%X', adler) as report from (select frame, is_nop, last_value(case when not is_nop then adler end ignore nulls) over (order by frame) as adler from ({_STORED}))",
    "frame_adler_check": f"select s.frame, s.adler as stored, c.adler as computed from ({_STORED}) s join ({_adler(TINY, 8)}) c on s.frame = c.frame where s.adler <> 0 and s.adler <> c.adler",
    "frame_duplicates": f"select frame, frame_class = 'nop' as is_duplicate from ({_classes(TINY, 10000)})",
    "all_keyframes": f"select bool_and(frame_class in ('key', 'nop')) as all_keyframes from ({_classes(TINY, 1)})",
    "delta_islands": f"select frame, min(idx) as start_idx, count(*) as num from (select *, idx - row_number() over (partition by frame order by idx) as isl from ({_DELTA})) group by frame, isl",
    "delta_runs": f"{_RUNS} select * from runs",
    "delta_codes": f"{_CODES} select * from codes",
    "codes_skip_after": f"{_FOLDED} select * from folded",
    "c4_word32_pack": f"{_FOLDED} select frame, seq, op, num * 1024 + case op when 'SKIP' then 0 when 'DUP' then 1 when 'COPY' then 2 else 3 end * 256 + skip_after as word from folded",
    "decode_forward_fill": TINY,
    "gop_seek": f"select frame, frame_class, cast(sum(case when frame_class = 'key' then 1 else 0 end) over (order by frame) as bigint) as gop from ({_classes(STD, 12)})",
    "gop_seek_start": f"select max(frame) as start_frame from ({_classes(STD, 12)}) where frame_class = 'key' and frame <= 10",
    "crop": f"select frame, (idx // 10 - 3) * 5 + idx % 10 - 2 as idx, px from ({STD}) where idx % 10 between 2 and 6 and idx // 10 between 3 and 6",
    "fourup": f"select cast(1 + (case when idx % 10 >= 5 then 1 else 0 end) + (case when idx // 10 >= 5 then 2 else 0 end) as int) as quadrant, frame, (idx // 10 % 5) * 5 + idx % 10 % 5 as idx, px from ({STD})",
    "resize_double": f"select frame, (idx // 10 * 2 + dy) * 20 + idx % 10 * 2 + dx as idx, px from ({STD}), (select unnest([0, 1]) as dx), (select unnest([0, 1]) as dy)",
    "resize_half_box": f"select frame, idx // 20 * 5 + idx % 10 // 2 as idx, cast(sum(a) // 4 * 16777216 + sum(r) // 4 * 65536 + sum(g) // 4 * 256 + sum(b) // 4 as bigint) as px from ({_PARTS} from ({STD})) group by 1, 2",
    "resize_nearest": f"select s.frame, t.ty * 7 + t.tx as idx, s.px from ({STD}) s join (select x.tx, y.ty from (select unnest(range(0, 7)) as tx) x, (select unnest(range(0, 13)) as ty) y) t on s.idx = t.ty * 10 // 13 * 10 + t.tx * 10 // 7",
    "flatten": f"select frame * 100 + idx as flat_idx, px from ({STD})",
    "unflatten": STD,
    "alphamap": f"select frame, idx, coalesce({_MAP}, a) * 16777216 + (px & 16777215) as px from ({_PARTS} from ({RGBA}))",
    "alphamap_count": f"select count({_MAP}) as modified from ({_PARTS} from ({RGBA}))",
    "splitalpha_rgb": f"select frame, idx, ({_UNPX}) & 16777215 as px from ({_PARTS} from ({RGBA}))",
    "splitalpha_alpha": f"select frame, idx, a * 65793 as px from ({_PARTS} from ({RGBA}))",
    "joinalpha": RGBA,
    "mixalpha": f"select frame * 2 as frame, idx, ({_UNPX}) & 16777215 as px from ({_PARTS} from ({RGBA})) union all select frame * 2 + 1, idx, a * 65793 from ({_PARTS} from ({RGBA}))",
    "unmixalpha": RGBA,
    "mixstraight": f"select frame * 2 as frame, idx, px from ({STD}) union all select frame * 2 + 1, idx, px from ({MOD})",
    "rdelta_mask": f"select a.frame, a.idx, a.px as old_px, b.px as new_px from ({STD}) a join ({MOD}) b on a.frame = b.frame and a.idx = b.idx where a.px <> b.px",
    "rdelta_count": f"select count(*) as modified from ({STD}) a join ({MOD}) b on a.frame = b.frame and a.idx = b.idx where a.px <> b.px",
    "rdelta_overlay": f"""select o.frame, o.idx, case when o.px = m.px then m.px else least(a * 128 // 255 + 127, 255) * 16777216 + least(r * 128 // 255 + 127, 255) * 65536 + g * 128 // 255 * 256 + b * 128 // 255 end as px
      from ({STD}) o join ({_PARTS} from ({MOD})) m on o.frame = m.frame and o.idx = m.idx""",
    "fps_label": f"select p_partkey, {_LABEL} as label from (select p_partkey, {_D} as d from part)",
    "fps_parse": f"select p_partkey, p_size || '/1' as spec, cast({_D} as double) as duration from part",
    "trailing_nops": """select user_id, event_id, dur_us, greatest((2 * dur_us + 41667) // (2 * 41667) - 1, 0) as nops from (select user_id, event_id, epoch_us(lead(ts) over w) - epoch_us(ts) as dur_us from events
      window w as (partition by user_id order by ts, event_id)) where dur_us is not null""",
    "movie_info": """select movie, 3 as version, width, height, bpp, 'sRGB' as colorspace, '0.0417' as frame_duration, '24/1' as fps, cast((select count(*) from orders) // size as int) as num_frames, false as all_keyframes,
      round(cast(cast(1 as float) / cast(24 as float) as double) * ((select count(*) from orders) // size), 3) as duration, bpp = 32 as has_alpha
      from (values ('std', 10, 10, 24, 100), ('tiny', 2, 1, 24, 2), ('rgba', 10, 10, 32, 100)) t(movie, width, height, bpp, size)""",
    "movie_names": "select movie, movie || '_rgb.anim' as name_rgb, movie || '_alpha.anim' as name_alpha, movie || '_mix.anim' as name_mix, movie || '_q1.anim' as name_q1 from (values ('std'), ('tiny'), ('rgba')) t(movie)",
    "mov_frame_to_sample": f"select unnest(range(s // 2, (s + dur) // 2)) as frame, sample from (select *, cast(coalesce(sum(dur) over (order by sample rows between unbounded preceding and 1 preceding), 0) as bigint) as s from ({MOV}))",
    "mov_start_times": f"select sample, cast(coalesce(sum(dur) over (order by sample rows between unbounded preceding and 1 preceding), 0) as bigint) as start_time from ({MOV})",
    "mov_frame_step": f"select min(dur) as smallest, cast(sum(dur) as bigint) as total, max(size) as largest_size, min(dur) <> 1 as valid from ({MOV})",
    "mov_chunk_asof": f"select chunk, (chunk // 10 * 10) % 7 + 1 as samples_per_chunk from (select distinct chunk from ({MOV}))",
    "mov_sample_offset": f"select sample, cast(chunk * 16384 + coalesce(sum(size) over (partition by chunk order by sample rows between unbounded preceding and 1 preceding), 0) as bigint) as file_offset from ({MOV})",
    "mov_sync_flag": f"select sample, sample % 12 = 0 as is_key from ({MOV})",
}


def queries() -> dict:
    from . import file_queries

    return QUERIES | file_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import file_queries

    return ORACLE | file_queries.ORACLE
