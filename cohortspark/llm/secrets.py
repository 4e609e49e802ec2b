"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Three base kinds are found by pattern; a fourth one (``live``) takes what looks
like a credential by itself and overlaps no base span: a run of 20 or more token
characters, at most half of it in word-like pieces, that has digits, capitals
and small letters or begins as a known issuer's keys do.  Addresses, paths,
UUIDs and digests don't look like that.  The value of every candidate is hashed
and counted over the corpus by distinct owners (and repositories, which
``ownership`` gives too): a value that more than ``EXAMPLE_OWNERS`` owners have
is a widely copied example, the others look live.  In the report base spans
always stay; a ``live`` span stays only if it isn't such an example.

``redact`` masks assigned values and access keys always, ``live`` spans that
aren't examples, and hexadecimal runs that are neither examples nor as long as
the usual digests (``DIGESTS``).

Positions come from the pattern's split: matches and the gaps between them
alternate, so running sums of their lengths (in code points) are the positions.
Running sums and masks are folded in blocks, and text is cut within blocks, so
a text with a hundred thousand hits takes seconds.

Cases: a null text counts as empty; a null owner is an owner of its own; rows
with equal id and text are one repository; values that tie in position are
listed by kind; a very long text gives all its spans; empty tables give empty
results; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, saved

KINDS = ("assign", "access", "hex", "live")
EXAMPLE_OWNERS = 3
MASK = "[SECRET]"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The base patterns and the fewest characters that count.
ASSIGN = "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = "AKIA[A-Z0-9]{16,}"  # 20 characters or more; shorter runs hold no longer match
HEX = "[0-9a-f]{24,}"  # likewise
BROAD = "[A-Za-z0-9+/_-]{20,}"
#: How keys of known issuers begin, and the lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 in hexadecimal digits.
ISSUED = "^(gh[oprsu]_|github_pat_|glpat-|xox[abprs]-|[rs]k_live_|[rs]k_test_|sk-|AIza|ya29|eyJ|npm_|pypi-|hf_)"
DIGESTS = (32, 40, 56, 64, 96, 128)
WORD_LIKE = "[A-Za-z][a-z]{3,}"
#: How many items a fold takes at once, and how many code points a block of text has.
BLOCK = 256
TEXT_BLOCK = 4096


def _let(value: Column, then) -> Column:
    """``then(value)``, the value being worked out once however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _scanned(items: Column, zero: Column, kind: str, step) -> Column:
    """What a running fold puts out: step(state, item) gives the next state and an output of type ``kind``, as a pair.

    Appending copies what is there, so items are folded in blocks whose outputs are appended as one.
    """
    none = F.array().cast(f"array<{kind}>")

    def fold(block: Column, state: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            following, out = step(acc["state"], x)
            return F.struct(following.alias("state"), F.concat(acc["out"], F.array(out.cast(kind))).alias("out"))

        return F.aggregate(block, F.struct(state.alias("state"), none.alias("out")), one)

    def blocks(x: Column) -> Column:
        n = F.size(x)
        return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda k: F.transform(F.sequence(k * BLOCK, F.least(n, (k + 1) * BLOCK) - 1), lambda j: F.get(x, j)))

    def joined(acc: Column, block: Column) -> Column:
        return _let(fold(block, acc["state"]), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    start = F.struct(zero.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return _let(items, lambda x: F.when(F.size(x) > 0, F.flatten(F.aggregate(blocks(x), start, joined)["out"])).otherwise(none))


def _found(text: Column, pattern: str, kind: int, value: str, keep: str) -> Column:
    """array<struct<s, k, e, v>> of the pattern's matches; ``value`` and ``keep`` say what to hash of a match, and which count."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"), F.split(text, pattern, -1).alias("g"))

    def placed(x: Column) -> Column:
        ends = _scanned(F.transform(x["m"], lambda m, i: F.length(m) + F.length(F.get(x["g"], i))), F.lit(0), "int", lambda at, n: (at + n, at + n))
        spans = lambda e: F.transform(x["m"], lambda m, i: F.struct((F.get(e, i) - F.length(m)).alias("s"), F.lit(kind).alias("k"), F.get(e, i).alias("e"), F.xxhash64(_value(m, value)).alias("v"), _keep(m, keep).alias("ok")))
        return _let(ends, spans)

    return F.transform(F.filter(_let(both, placed), lambda x: x["ok"]), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["v"].alias("v")))


def _value(m: Column, how: str) -> Column:
    return F.regexp_extract(m, ASSIGN, 2) if how == "assign" else m


def _keep(m: Column, how: str) -> Column:
    if how == "assign":
        return F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST
    if how == "credential":
        mixed = m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")
        return (mixed | m.rlike(ISSUED) & m.rlike("[0-9]")) & (2 * F.length(F.regexp_replace(m, WORD_LIKE, "")) >= F.length(m))
    return F.lit(True)


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """(id, part, owner, base, extra): the spans of every row, written once to the shared folder.  part: hash of the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<s:int,k:int,e:int,v:bigint>>")
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("part"), F.col(owner).alias("owner"), t.alias("t"))
    some = lambda pattern, found: F.when(F.col("t").rlike(pattern), found).otherwise(none)
    base = F.concat(
        some(ASSIGN, _found(F.col("t"), ASSIGN, 0, "assign", "assign")),
        F.when(F.contains(F.col("t"), F.lit("AKIA")), _found(F.col("t"), ACCESS, 1, "whole", "all")).otherwise(none),
        some(HEX, _found(F.col("t"), HEX, 2, "whole", "all")))
    extra = some(BROAD, _found(F.col("t"), BROAD, 3, "whole", "credential"))
    spans = rows.select("id", "part", "owner", F.array_sort(base).alias("base"), extra.alias("all_extra"))
    apart = F.filter("all_extra", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return saved(spans.select("id", "part", "owner", "base", apart.alias("extra")), "spans")


def ownership(found: DataFrame) -> DataFrame:
    """(v, owners, repositories): in how many a value occurs.  Every step is a partial aggregation, so a value in a third of all rows is no hot spot."""
    each = found.select("id", "part", "owner", F.explode(F.concat("base", "extra")).alias("x")).select("id", "part", "owner", F.col("x.v").alias("v"))
    repos = each.groupBy("v", "owner", "id", "part").agg(F.lit(1).alias("one"))
    return repos.groupBy("v", "owner").agg(F.count("*").alias("n")).groupBy("v").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def classified(found: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """``found`` with ``spans`` (base and live ones by start, then kind) and ``examples`` (hashes of the row's widely copied values)."""
    wide = ownership(found).where(F.col("owners") > example_owners).select("v")
    each = found.select("id", "part", F.explode(F.concat("base", "extra")).alias("x")).select("id", "part", F.col("x.v").alias("v"))
    mine = each.join(wide, "v").groupBy("id", "part").agg(F.collect_set("v").alias("examples"))
    mine = mine.select(F.col("id").alias("_id"), F.col("part").alias("_part"), "examples")
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("part").eqNullSafe(F.col("_part"))
    got = found.join(mine, same, "left").select("id", "part", "base", "extra", F.coalesce("examples", F.array().cast("array<bigint>")).alias("examples"))
    live = F.filter("extra", lambda x: ~F.array_contains(F.col("examples"), x["v"]))
    return got.select("id", "part", "base", "examples", F.array_sort(F.concat("base", live)).alias("spans"))


def listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row for each input row: counts by base kind, digest of the base spans, all spans, and how many spans are examples."""
    got = classified(candidates(docs, doc_id, text, owner), example_owners)
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return got.select(
        F.col("id").alias("doc_id"), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"),
        F.size(F.filter("spans", lambda x: F.array_contains(F.col("examples"), x["v"]))).cast("long").alias("n_example"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", n_chars: str = "n_chars", mask: str = MASK) -> DataFrame:
    """The rows and columns of ``docs`` with every span of the texts replaced by ``mask`` (touching or overlapping spans by one)."""
    got = classified(candidates(docs, doc_id, text, owner))
    digest = lambda x: (x["k"] == 2) & ((x["e"] - x["s"]).isin(*DIGESTS) | F.array_contains(F.col("examples"), x["v"]))
    got = got.select("id", "part", F.filter("spans", lambda x: ~digest(x)).alias("spans")).where(F.size("spans") > 0)
    own_id, own_part, own_spans = (free_name(docs, c) for c in ("_id", "_part", "_spans"))
    got = got.groupBy(F.col("id").alias(own_id), F.col("part").alias(own_part)).agg(F.first("spans").alias(own_spans))
    both = docs.join(got, docs[doc_id].eqNullSafe(F.col(own_id)) & (F.xxhash64(docs[text]) == F.col(own_part)), "left")
    spans = F.col(own_spans)
    new = F.when(spans.isNull(), docs[text]).otherwise(_masked(docs[text], spans, mask))
    kinds = dict(docs.dtypes)
    cols = {text: new}
    if n_chars in kinds:
        cols[n_chars] = F.when(spans.isNull(), docs[n_chars]).otherwise(F.length(new).cast(kinds[n_chars]))
    return both.select(*((cols[c] if c in cols else docs[c]).alias(c) for c in docs.columns))


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with each span, by start, replaced; touching or overlapping ones by one mask."""
    # (from, to, end): what is copied before a mask, and where the span ends; from = to where none is needed
    step = lambda at, x: (F.greatest(at, x["e"]), F.struct(F.least(at, x["s"]).alias("a"), x["s"].alias("z"), F.greatest(at, x["e"]).alias("e")))
    pieces = _scanned(spans, F.lit(0), "struct<a:int,z:int,e:int>", step)
    parts = F.struct(pieces.alias("p"), F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % TEXT_BLOCK), F.lit(0)).alias("b"), F.length(text).alias("n"))

    def cut(b: Column, a: Column, z: Column) -> Column:
        """Characters [a, z) from the blocks."""
        first, last = F.floor(a / TEXT_BLOCK).cast("int"), F.floor((z - 1) / TEXT_BLOCK).cast("int")
        one = F.substr(F.get(b, first), a % TEXT_BLOCK + 1, z - a)
        more = F.concat(F.substr(F.get(b, first), a % TEXT_BLOCK + 1), F.array_join(F.slice(b, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substr(F.get(b, last), F.lit(1), z - last * TEXT_BLOCK))
        return F.when(z <= a, F.lit("")).when(first == last, one).otherwise(more)

    def put(x: Column) -> Column:
        masked = F.transform(x["p"], lambda p, i: F.when((i == 0) | (p["z"] > p["a"]), F.concat(cut(x["b"], p["a"], p["z"]), F.lit(mask))).otherwise(F.lit("")))
        return F.concat(F.array_join(masked, ""), cut(x["b"], F.get(x["p"], F.size(x["p"]) - 1)["e"], x["n"]))

    return _let(parts, put)
