"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only.

Cut a line into segments: at most ``tau`` edits lie in ``tau`` of them, and the
others stand in the other line at places that its length bounds.  Every line
indexes what is left of it without each choice of ``tau`` segments, and probes,
for each length ``tau`` or less below its own, only the substrings at the places
where the rest can stand.  Equal keys make candidates, and a banded bit-parallel
edit distance decides.

The first level cuts into ``tau + 1`` segments, of which one must be whole: few
rows, and enough for most lines.  Keys that many lines index (a frequent opening, a
family of variants) make no candidates there: their lines go on to a second level
with ``2 tau + 1`` segments, of which all but ``tau`` must be whole, among them those that
the shared key holds.  Lines of a key that is still shared by many go on with only the
part that the key leaves open, under half of the text, and so on.  Lines that meet below
the first level become a pair only where their characters and neighbouring characters,
counted as odd or even, differ as little as ``tau`` edits allow: the pairs looked at
stay near those that do link, not the square of a group.

Lines of ``tau`` characters or fewer all link with each other; they are tied to one
of them and their links counted.  Their links with lines of up to ``2 tau`` characters
are many wherever such lines are, so these are counted by what both have in common,
and never become rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import connected_components

#: Edits at which two lines still link.
TAU = 2
#: A key that more lines index is looked at on the next level: on the first, and on those whose pairs are sifted.
HOT = 10
DEEP = 512
#: Places of a short line's pattern counts in the join that looks them up: a frequent one is dealt over them.
DEALT = 16


def distinct_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``line_key, line_id, line, n_chars, n_rows, first_id`` of every line that isn't empty.

    ``line_key`` is a number that no other line has, once the table is written; ``line_id`` its MD5.
    """
    lines = docs.select(F.col(id_col).cast("long").alias("row_id"), F.explode(F.split(F.coalesce(text_col, F.lit("")), "\n", -1)).alias("line")).filter("line <> ''")
    folded = lines.groupBy("line").agg(F.count("*").alias("n_rows"), F.min("row_id").alias("first_id"))
    return folded.select(F.monotonically_increasing_id().alias("line_key"), F.md5("line").alias("line_id"), "line", F.length("line").cast("long").alias("n_chars"), "n_rows", "first_id")


def cuts(parts: int, tau: int, less: int) -> list[tuple[int, ...]]:
    """Which segments of ``parts`` an edited line may lack: ``tau`` holes of first segment, end and the shift after it.

    ``tau`` segments are chosen and neighbours make one hole; a hole of c segments
    shifts what follows by c or less, and the last hole by ``less`` in all.  Holes
    that aren't needed stand at the end.
    """
    found = []
    for chosen in combinations(range(parts), tau):
        holes: list[list[int]] = []
        for i in chosen:
            if holes and holes[-1][1] == i:
                holes[-1][1] = i + 1
            else:
                holes.append([i, i + 1])
        for moves in product(*[range(b - e, e - b + 1) for b, e in holes[:-1]]):
            shifts = [sum(moves[: k + 1]) for k in range(len(moves))] + [less]
            b, e = holes[-1]
            if abs(less - sum(moves)) <= e - b:
                row = [x for (b, e), t in zip(holes, shifts, strict=True) for x in (b, e, t)]
                found.append(tuple(row + [parts, parts, less] * (tau - len(holes))))
    return found


def _moves(parts: int, tau: int, probe: bool) -> list[tuple[int, ...]]:
    """The cuts that a line is probed by, or indexed by: the difference in length, then the holes.

    What is indexed stands at its own place, without shifts.  Of two lines of one
    length each probes the other, and what is shifted back for one is shifted ahead
    for the other: with two edits, which have one shift between them, those ahead are enough.
    """
    if not probe:
        return [(0, *c) for c in cuts(parts, tau, 0) if not any(c[2::3])]
    return [(less, *c) for less in range(tau + 1) for c in cuts(parts, tau, less) if less or tau > 2 or c[2] >= 0]


def _plain(move: tuple[int, ...]) -> bool:
    """Whether a text is probed there by what it indexes: at no difference in length and no shift."""
    less, *holes = move
    return less == 0 and not any(holes[2::3])


def _kept(parts: int, holes: tuple[int, ...]) -> dict[int, int]:
    """The segments that a cut keeps, with their shifts."""
    at, shift, kept = 0, 0, {}
    for b, e, t in [*zip(*[iter(holes)] * 3, strict=True), (parts, parts, 0)]:
        kept |= dict.fromkeys(range(at, b), shift)
        at, shift = e, t
    return kept


def within(parts: int, tau: int, cut: tuple[int, ...]) -> list[int]:
    """The cuts of the first level whose segment the cut (difference in length, then holes) into ``parts`` keeps too, at the same place.

    Two texts that link, and share the first one's key, share one of these keys: with up
    to two edits, those of an alignment that keeps a segment of the first level can all
    be put into segments beside what lies inside it.  With more edits every cut stays.
    """
    kept, n, found = _kept(parts, cut[1:]), parts if parts <= 2 * tau else parts * (tau + 1), []
    for number, (less, *holes) in enumerate(_moves(tau + 1, tau, True)):
        ((i, shift),) = _kept(tau + 1, tuple(holes)).items()
        inside = [j for j in range(parts) if i * n // (tau + 1) <= j * n // parts and (j + 1) * n // parts <= (i + 1) * n // (tau + 1)]
        if less == cut[0] and (tau > 2 or all(kept.get(j) == shift for j in inside)):
            found.append(number)
    return found


def _piece(s: str, a: str, b: str) -> str:
    return f"substring({s}, cast({a} as int) + 1, cast(({b}) - ({a}) as int))"


def first_keys(lines: DataFrame, tau: int, probe: bool) -> DataFrame:
    """``key, id, cut`` of the first level, where one of ``tau + 1`` segments is kept; cut counts through ``_moves``.

    Each difference in length is a projection of its own over ends worked out once:
    with all keys in one, the code that Spark makes is too long to be compiled.
    """
    keys: dict[int, list[str]] = {}
    for cut, (less, *holes) in enumerate(_moves(tau + 1, tau, probe)):
        at, shift, kept = 0, 0, []
        for b, e, t in [*zip(*[iter(holes)] * 3, strict=True), (tau + 1, tau + 1, 0)]:
            if b > at:
                kept.append((at, f"substring(line, e{at} + {shift + 1}, e{b} - e{at})"))
            at, shift = e, t
        ((segment, text),) = kept
        keys.setdefault(less, []).append(f"named_struct('cut', {cut}, 'key', xxhash64(n, {segment}, {text}))")
    ends = [f"cast({i} * n div {tau + 1} as int) as e{i}" for i in range(tau + 2)]
    found = []
    for less, some in keys.items():
        cut = lines.selectExpr("line_key as id", "line", f"n_chars - {less} as n").filter(F.col("n") > tau).selectExpr("id", "line", "n", *ends)
        found.append(cut.select("id", F.expr(f"inline(array({', '.join(some)}))")))
    return reduce(DataFrame.unionByName, found)


def _holes(rows: DataFrame, tau: int, parts: range, probe: bool) -> DataFrame:
    """A fixed table of cuts: k, d (difference in length), cut, then b, e, t of each hole, the first cuts that it is within, and whether it shifts nothing; k = 0 leaves all open."""
    names = [f"{x}{i}" for i in range(1, tau + 1) for x in "bet"]
    table = [(k, m[0], cut, *m[1:], within(k, tau, m), _plain(m)) for k in parts for cut, m in enumerate(_moves(k, tau, probe))]
    table += [(0, d, -1, *(0, 0, d) * tau, [], d == 0) for d in range(tau + 1 if probe else 1)]
    return F.broadcast(rows.sparkSession.createDataFrame(table, ", ".join(f"{c} int" for c in ("k", "d", "cut", *names)) + ", firsts array<int>, plain boolean"))


def _edge(i: str) -> str:
    return f"if(k = 0, 0, {i} * n div k)"


def _cut(rows: DataFrame, tau: int, probe: bool) -> DataFrame:
    """Rows ``g, s, less, id, row, sign, ways, both`` once for each of their cuts: all, or those within one of ``ways``.

    Of probes that are indexed as well (``both``), only the cuts that aren't made for the index.
    Texts of fewer than ``2 tau + 1`` characters are cut into single ones; of ``tau`` or fewer, all of one ``g`` meet.
    """
    n = F.length("s") - F.col("less")
    cut = rows.withColumn("n", n).withColumn("parts", F.when(n > tau, F.least(n, F.lit(2 * tau + 1))).otherwise(0))
    wanted = (F.col("ways").isNull() | F.arrays_overlap("ways", "firsts")) & ~(F.col("both") & F.col("plain"))
    return cut.join(_holes(rows, tau, range(tau + 1, 2 * tau + 2), probe), (F.col("parts") == F.col("k")) & (F.col("less") == F.col("d")) & wanted)


def _open_pieces(tau: int) -> list[str]:
    shifts = ["0", *[f"t{i}" for i in range(1, tau + 1)]]
    return [_piece("s", f"{_edge(f'b{i}')} + {shifts[i - 1]}", f"{_edge(f'e{i}')} + {shifts[i]}") for i in range(1, tau + 1)]


def deeper_keys(rows: DataFrame, tau: int, probe: bool) -> DataFrame:
    """``key, row, id, cut, sign, open, h1, ...``: the name of what a cut keeps within ``g``, and of what stands in each of several holes."""
    kept, at, shift = [], "0", "0"
    for i in range(1, tau + 1):
        kept.append(_piece("s", f"{at} + {shift}", f"{_edge(f'b{i}')} + {shift}"))
        at, shift = _edge(f"e{i}"), f"t{i}"
    kept.append(_piece("s", f"{at} + less", "if(k = 0, 0, n) + less"))
    where = ", ".join(f"b{i}, e{i}" for i in range(1, tau + 1))
    several = "b2 < e2 and " if tau > 1 else "false and "
    holes = [F.expr(f"if({several}b{i} < e{i}, xxhash64({text}), null)").alias(f"h{i}") for i, text in enumerate(_open_pieces(tau), 1)]
    key = F.expr(f"xxhash64(g, k, {where}, {', '.join(kept)})").alias("key")
    return _cut(rows, tau, probe).select(key, "row", "id", "cut", "sign", (F.col("n") > 2 * tau + 1).alias("open"), *holes)


def left_open(keys: DataFrame, rows: DataFrame, tau: int, probe: bool) -> DataFrame:
    """Rows of the next level for ``keys``, without ``row``: of each text what its cut doesn't keep."""
    rows = likely(rows, keys.select("row").distinct(), "row").filter("hit").drop("hit")
    wanted = keys.select(F.col("key").alias("within"), F.col("row").alias("at"), F.col("cut").alias("way"))
    full = _cut(rows.join(wanted, F.col("at") == F.col("row")), tau, probe).filter("way = cut")
    return full.select(F.col("within").alias("g"), F.concat(*[F.expr(x) for x in _open_pieces(tau)]).alias("s"), "less", "id", "sign", F.lit(None).cast("array<int>").alias("ways"), F.lit(False).alias("both"))


def odd_characters(text: str) -> Column:
    """Whether a text holds an odd number of characters (``c``, 64 classes) and of neighbouring ones (``x`` and ``y``, 128 classes), bit by bit.

    An edit changes two bits of the first at most, and four of the others: two neighbourhoods go and two come.
    """
    flipped = "'x', if(q.at < 64, o.x ^ shiftleft(1L, q.at), o.x), 'y', if(q.at < 64, o.y, o.y ^ shiftleft(1L, q.at - 64))"
    step = _bound("'at', cast(pmod(xxhash64(o.last, c), 128) as int)", "q", f"named_struct('c', o.c ^ shiftleft(1L, ascii(c) % 64), {flipped}, 'last', c)")
    start = "named_struct('c', 0L, 'x', 0L, 'y', 0L, 'last', '')"
    return F.expr(f"aggregate(split({text}, ''), {start}, (o, c) -> {step}, o -> named_struct('c', o.c, 'x', o.x, 'y', o.y))")


def alike(sign: str, mark: str, tau: int) -> Column:
    """Whether two texts may be ``tau`` edits apart, by their :func:`odd_characters`."""
    changed = lambda part: F.bit_count(F.col(f"{sign}.{part}").bitwiseXOR(F.col(f"{mark}.{part}")))
    return (changed("c") <= 2 * tau) & (changed("x") + changed("y") <= 4 * tau)


def likely(rows: DataFrame, wanted: DataFrame, key: str = "line_key") -> DataFrame:
    """``rows`` with ``hit``: false only where ``key`` isn't in ``wanted(key)``.

    A bitmap of at most 2**19 words (a row of two numbers each) over hashes of the
    wanted keys; a fuller one only lets more through.  It keeps most rows out of the
    shuffles that follow.
    """
    words = min(1 << 19, max(1 << 10, 1 << (wanted.count() // 4).bit_length()))
    spot = F.pmod(F.xxhash64(key), F.lit(words * 64))
    marks = wanted.select(spot.alias("spot")).select(F.shiftright("spot", 6).alias("word"), F.expr("shiftleft(1L, cast(spot & 63 as int))").alias("bit"))
    table = F.broadcast(marks.groupBy("word").agg(F.bit_or("bit").alias("bits")))
    asked = rows.withColumn("spot", spot).withColumn("place", F.shiftright("spot", 6))
    found = asked.join(table, F.col("place") == F.col("word"), "left")
    return found.withColumn("hit", F.expr("coalesce(getbit(bits, cast(spot & 63 as int)) = 1, false)")).drop("spot", "place", "word", "bits")


def _shared(x: str, y: str, most: str) -> str:
    """How many characters two texts begin with alike, at most ``most`` (and 32767), by halving steps."""
    steps = ", ".join(str(1 << k) for k in range(14, -1, -1))
    return f"aggregate(array({steps}), 0, (k, s) -> if(k + s <= {most} and substring({x}, k + 1, s) = substring({y}, k + 1, s), k + s, k))"


def _bound(values: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for values worked out once: a lambda variable, which no rule copies."""
    return f"element_at(transform(array(named_struct({values})), {name} -> {body}), 1)"


def edits_within(tau: int, shorter: str = "shorter", longer: str = "longer") -> Column:
    """Whether two texts of ``tau`` or more characters, the first not longer, are at most ``tau`` edits apart.

    What they begin and end with alike is cut off, but for ``tau`` characters.
    Bit r of the words stands for row ``j - tau - 2 + r`` of column j; the last bit's
    diagonal is followed down to the pattern's end, then its last row to the right.
    """
    wide = 2 * tau + 3
    full, top = (1 << wide) - 1, 1 << (wide - 1)
    first = ((1 << (tau + 1)) - 1) << (wide - tau - 1)

    def bit(r: int) -> str:
        row = f"(q.j + {r - (wide - 1) + tau})"
        return f"if({row} between 1 and q.m and try_element_at(z.p, {row}) = q.c, {1 << r}L, 0L)"

    # Match bits -> D0 -> HP and HN -> next state.
    row_bit = f"shiftright({top}L, q.j + {tau} - q.m)"
    moved = f"if(q.j + {tau} <= q.m, if((q.d & {top}L) = 0, 1, 0), if((q.hp & {row_bit}) <> 0, 1, 0) - if((q.hn & {row_bit}) <> 0, 1, 0))"
    state = f"named_struct('vp', (q.hn | ~(shiftright(q.d, 1) | q.hp)) & {full}L, 'vn', shiftright(q.d, 1) & q.hp, 'dist', s.dist + {moved})"
    body = _bound(f"'j', q.j, 'm', q.m, 'd', q.d, 'hp', (s.vn | ~(q.d | s.vp)) & {full}L, 'hn', q.d & s.vp", "q", state)
    body = _bound(f"'j', q.j, 'm', q.m, 'd', ((((q.x & s.vp) + s.vp) ^ s.vp) | q.x | s.vn) & {full}L", "q", body)
    body = _bound(f"'j', q.j, 'm', q.m, 'x', {' | '.join(bit(r) for r in range(wide))}", "q", body)
    body = _bound("'j', j, 'm', z.m, 'c', element_at(z.t, j)", "q", body)
    walk = (
        f"aggregate(sequence(1, size(z.t)), named_struct('vp', {first}L, 'vn', 0L, 'dist', {tau}), "
        f"(s, j) -> if(s.dist > {3 * tau}, s, {body}), s -> s.dist <= {tau})"
    )
    walk = _bound("'p', z.p, 't', z.t, 'm', size(z.p)", "z", walk)
    walk = _bound("'p', split(substring(z.x, 1, length(z.x) - z.e), ''), 't', split(substring(z.y, 1, length(z.y) - z.e), '')", "z", walk)
    walk = _bound(f"'x', z.x, 'y', z.y, 'e', {_shared('reverse(z.x)', 'reverse(z.y)', f'length(z.x) - {tau}')}", "z", walk)
    walk = _bound("'x', substring(z.x, z.b + 1), 'y', substring(z.y, z.b + 1)", "z", walk)
    walk = _bound(f"'x', z.x, 'y', z.y, 'b', greatest(0, {_shared('z.x', 'z.y', 'length(z.x)')} - {tau})", "z", walk)
    return F.expr(_bound(f"'x', {shorter}, 'y', {longer}", "z", walk))


def _whole(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """The lines of ``wanted(id, less, ways, both)`` as rows of the second level."""
    texts = likely(lines, wanted.select(F.col("id").alias("line_key")).distinct()).filter("hit").select("line_key", "line", "n_chars")
    rows = texts.join(wanted, F.col("line_key") == F.col("id")).select((F.col("n_chars") - F.col("less")).alias("g"), F.col("line").alias("s"), "less", "id", odd_characters("line").alias("sign"), "ways", "both")
    return _numbered(rows, "line-rows")


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()), name)


def candidates(lines: DataFrame, tau: int = TAU) -> DataFrame:
    """``a, b``: keys of lines of more than ``tau`` characters that may link, once a pair."""
    both = lambda pairs: pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    longer = lines.filter(F.col("n_chars") > tau)
    own, sought = first_keys(longer, tau, False), first_keys(longer, tau, True)
    many = materialise(own.groupBy("key").agg(F.count("*").alias("lines")).filter(F.col("lines") > HOT).select("key"), "line-hot-keys")
    few = own.join(many, "key", "left_anti").select("key", F.col("id").alias("a"))
    met = both(few.join(sought.select("key", F.col("id").alias("b")), "key").filter("a <> b"))
    if many.isEmpty():
        return met.distinct()
    moves = _moves(tau + 1, tau, True)
    less = F.element_at(F.array(*[F.lit(m[0]) for m in moves]), F.col("cut") + 1)
    still = F.col("cut").isin([i for i, m in enumerate(moves) if _plain(m)])
    hot = sought.join(many, "key", "left_semi").groupBy("id", less.alias("less"))
    hot = materialise(hot.agg(F.collect_set("cut").alias("ways"), F.collect_set(F.when(still, F.col("cut"))).alias("own")), "line-wanted")
    both_ways = F.size("own") > 0
    index = _whole(longer, hot.filter(both_ways).select("id", "less", F.col("own").alias("ways"), F.lit(False).alias("both")))
    probe = _whole(longer, hot.select("id", "less", "ways", both_ways.alias("both")))
    while True:
        # Written, as a text's cuts are looked at up to three times: cutting is a fixed number of rows a text, once.
        own, sought = materialise(deeper_keys(index, tau, False), "line-own"), materialise(deeper_keys(probe, tau, True), "line-sought")
        # Texts that are cut into single characters differ in those left out at most: that's a link, or nearly.
        many = own.filter("open").groupBy("key").agg(F.count("*").alias("lines")).filter(F.col("lines") > DEEP).select("key")
        many = materialise(many, "line-hot-keys")
        holes = [f"h{i}" for i in range(1, tau + 1)]
        few = own.join(many, "key", "left_anti").select("key", F.col("id").alias("a"), "sign", *holes)
        other = own.unionByName(sought).select("key", F.col("id").alias("b"), F.col("sign").alias("mark"), *[F.col(h).alias(f"o{h}") for h in holes])
        # Where one of several holes holds the same in both, a cut with fewer holes has the pair too.
        differ = " and ".join(f"coalesce({h} <> o{h}, true)" for h in holes)
        pairs = few.join(other, "key").filter("a <> b").filter(alike("sign", "mark", tau)).filter(differ)
        met = met.unionByName(both(pairs))
        if many.isEmpty():
            return met.distinct()
        on = lambda keys: materialise(keys.select("key", "row", "cut").join(many, "key", "left_semi"), "line-hot")
        index = _numbered(left_open(on(own), index, tau, False), "line-index")
        # What a text indexes it also probes, so those cuts are made once, for both.
        probe = _numbered(left_open(on(sought), probe, tau, True).unionByName(index.drop("row", "both").withColumn("both", F.lit(True))), "line-probes")


def edit_join(lines: DataFrame, tau: int = TAU) -> DataFrame:
    """``a, b``: keys of different lines of more than ``tau`` characters, at most ``tau`` edits apart, once a pair."""
    pairs = materialise(candidates(lines, tau), "line-pairs")
    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("line_key")).distinct(), "line-paired")
    texts = likely(lines, wanted).filter("hit").join(wanted, "line_key", "left_semi")
    texts = materialise(texts.select("line_key", "line", "n_chars"), "line-texts")
    side = lambda name: texts.select(F.col("line_key").alias(name), F.col("line").alias(f"line_{name}"), F.col("n_chars").alias(f"n_{name}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.abs(F.col("n_a") - F.col("n_b")) <= tau)
    shorter = F.col("n_a") <= F.col("n_b")
    ordered = full.select("a", "b", F.when(shorter, F.col("line_a")).otherwise(F.col("line_b")).alias("shorter"), F.when(shorter, F.col("line_b")).otherwise(F.col("line_a")).alias("longer"))
    return ordered.filter(edits_within(tau)).select("a", "b")


def alignments(m: int, n: int, tau: int) -> dict[tuple[int, ...], list[tuple[int, ...]]]:
    """What a line of ``m <= tau`` characters and one of ``n > tau`` must have in common to be ``tau`` edits apart or less.

    By places of the first, the places of the second that may hold the same
    characters; no pattern holds another.  Whatever stands between two places
    takes as many edits as the longer of its sides.
    """

    def edits(mine: tuple[int, ...], other: tuple[int, ...]) -> int:
        ends = [(-1, -1), *zip(mine, other, strict=True), (m, n)]
        return sum(max(b[0] - a[0], b[1] - a[1]) - 1 for a, b in zip(ends, ends[1:], strict=False))

    near = {(x, y) for k in range(1, m + 1) for x in combinations(range(m), k) for y in combinations(range(n), k) if edits(x, y) <= tau}
    parts = lambda x, y: {(tuple(x[i] for i in some), tuple(y[i] for i in some)) for k in range(1, len(x)) for some in combinations(range(len(x)), k)}
    found: dict[tuple[int, ...], list[tuple[int, ...]]] = {}
    for x, y in sorted(near):
        if not parts(x, y) & near:
            found.setdefault(x, []).append(y)
    return found


def _sign(i: int) -> str:
    return f"substring(line, {i + 1}, 1)"


def patterns(tau: int) -> tuple[dict[int, list[tuple[int, str]]], dict[int, list[tuple[int, str]]]]:
    """``weight, key`` expressions of short lines and of longer ones, by their number of characters.

    Two lines link if any of their alignments holds.  Each set of alignments has
    keys that two lines share where all of it holds, and odd sets count 1, even
    ones -1: over all that two lines share, that is 1 if they link and 0 if not.
    """
    short: dict[int, list[tuple[int, str]]] = {}
    longer: dict[int, list[tuple[int, str]]] = {}
    for m, n in product(range(1, tau + 1), range(tau + 1, 2 * tau + 1)):
        ways = alignments(m, n, tau) if n - m <= tau else {}
        for number, chosen in enumerate(c for k in range(1, len(ways) + 1) for c in combinations(ways, k)):
            weight, name = (-1) ** (len(chosen) + 1), f"'{m}.{n}.{number}.'"
            places = sorted({i for x in chosen for i in x})
            short.setdefault(m, []).append((weight, f"concat({name}, {', '.join(map(_sign, places))})"))
            keys = set()
            for others in product(*[ways[x] for x in chosen]):
                held: dict[int, list[int]] = {i: [] for i in places}
                for i, j in ((i, j) for x, y in zip(chosen, others, strict=True) for i, j in zip(x, y, strict=True)):
                    held[i].append(j)
                alike = sorted({f"{_sign(js[0])} = {_sign(j)}" for js in held.values() for j in js if j != js[0]})
                keys.add(f"if({' and '.join(alike) or 'true'}, concat({name}, {', '.join(_sign(held[i][0]) for i in places)}), null)")
            longer.setdefault(n, []).append((weight, f"array_distinct(array({', '.join(sorted(keys))}))"))
    return short, longer


def _keyed(lines: DataFrame, by_length: dict[int, list[tuple[int, str]]], several: bool) -> DataFrame:
    """``line_key, key, weight`` of the lines whose length has patterns."""
    own = lines.filter(F.col("n_chars").isin(list(by_length))).select("line_key", "line", "n_chars")
    each = lambda w, key: f"transform({key if several else f'array({key})'}, k -> named_struct('key', k, 'weight', {w}L))"
    whole = " ".join(f"when {n} then concat({', '.join(each(w, key) for w, key in keys)})" for n, keys in by_length.items())
    return own.select("line_key", F.explode(F.expr(f"case n_chars {whole} end")).alias("p")).select("line_key", "p.key", "p.weight").filter("key is not null")


def _weighed(rows: DataFrame, others: DataFrame) -> DataFrame:
    """``line_key, links`` of the lines of ``rows``, over the lines that ``others`` has under the same keys."""
    counts = others.groupBy(F.col("key").alias("shared")).agg(F.sum("weight").alias("links"))
    dealt = counts.select("shared", "links", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("deal"))
    met = rows.join(dealt, (F.col("key") == F.col("shared")) & (F.pmod(F.xxhash64("line_key"), F.lit(DEALT)) == F.col("deal")))
    return met.groupBy("line_key").agg(F.sum("links").alias("links")).filter("links > 0")


def short_links(lines: DataFrame, tau: int = TAU) -> DataFrame:
    """``line_key, links``: how many lines of more than ``tau`` characters each shorter one links with, and the other way round.

    With up to three edits lines are counted by :func:`patterns`, a few rows a line.
    Beyond that patterns are too many, and lines that share a character are compared.
    """
    low, high = (F.col("n_chars") <= tau), F.col("n_chars").between(tau + 1, 2 * tau)
    if tau <= 3:
        short, longer = patterns(tau)
        own, other = _keyed(lines.filter(low), short, False), _keyed(lines.filter(high), longer, True)
        return _weighed(own, other).unionByName(_weighed(other, own))
    signs = lambda some, name: lines.filter(some).select(F.explode(F.array_distinct(F.split("line", ""))).alias("sign"), F.col("line_key").alias(name), F.col("line").alias(f"line_{name}"))
    met = signs(low, "x").join(signs(high, "y"), "sign").filter(F.levenshtein("line_x", "line_y") <= tau).select("x", "y").distinct()
    return met.select(F.explode(F.array("x", "y")).alias("line_key")).groupBy("line_key").agg(F.count("*").alias("links"))


def near_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU) -> DataFrame:
    """One row per distinct line: ``line_id`` (MD5), n_chars, n_rows, first_id, n_links, class_id, kept.

    Lines are what stands between line feeds; empty ones and null texts give
    none, and so does an empty table.  Lines link within ``tau`` (1 or more)
    edits, at any length; ``class_id`` is the smallest line id reachable by links
    and its line is the one kept.  Repeated rows count in ``n_rows``; null ids only
    leave ``first_id`` null where a line has no other.  Other columns aren't read,
    whatever their names.
    """
    lines = materialise(distinct_lines(docs, id_col, text_col), "lines")
    links = materialise(edit_join(lines, tau), "line-links")
    short = materialise(short_links(lines, tau), "line-short-links")
    degree = links.select(F.explode(F.array("a", "b")).alias("line_key"), F.lit(1).cast("long").alias("links")).unionByName(short)
    degree = degree.groupBy("line_key").agg(F.sum("links").alias("links"))
    tiny = lines.filter(F.col("n_chars") <= tau)
    first = tiny.agg(F.min("line_key").alias("b"), (F.count("*") - 1).alias("others"))
    # A line that links with a short one is in the component of all of them.
    star = tiny.select(F.col("line_key").alias("a")).unionByName(short.select(F.col("line_key").alias("a"))).distinct()
    star = star.join(F.broadcast(first.select("b")), F.col("a") != F.col("b"))
    named = materialise(connected_components(links.unionByName(star), local_edges=-1).withColumnRenamed("node", "line_key"), "line-components")
    plain = likely(lines.select("line_key", "line_id", "n_chars", "n_rows", "first_id"), named.select("line_key"))
    linked = plain.filter("hit").select("line_key", "line_id").join(named, "line_key")
    heads = linked.groupBy("component").agg(F.min("line_id").alias("class_id"))
    classes = linked.join(heads, "component").join(degree, "line_key", "left").select(F.col("line_key").alias("k"), "links", "class_id")
    out = plain.filter("hit").join(classes, F.col("line_key") == F.col("k"), "left")
    out = out.unionByName(plain.filter("not hit"), allowMissingColumns=True)
    out = out.join(F.broadcast(first.select("others")), F.col("n_chars") <= tau, "left")
    class_id = F.coalesce("class_id", "line_id")
    n_links = F.coalesce("links", F.lit(0)) + F.coalesce("others", F.lit(0))
    return out.select("line_id", "n_chars", "n_rows", "first_id", n_links.cast("long").alias("n_links"), class_id.alias("class_id"), (class_id == F.col("line_id")).alias("kept"))
