"""Chat formatting over typed content parts, in DataFrame operations only.

A message is a list of typed parts: text, image, audio, document. A visitor
walks them in order: text is escaped, every other part becomes a placeholder
``<kind:k>``, its reference and its expanded token count are recorded. Turns are
marked ``<turn role="R">`` ... ``</turn>``. Escaping maps ``\\``, ``<`` and
``>`` to two characters each, so that a bare ``<`` or ``>`` in the output is
always the template's; it is a prefix code and hence reversible. The loss mask
is a list of code-point spans of the output.

A conversation is put together in two levels, blocks of ``BLOCK`` turns and
then blocks, so no task gathers more single turns than a block; what a
conversation's last row holds is its own output.

Defined results: a null text or role is empty; null part lists have no parts;
turns with the same number are ordered by role and text; a null turn number is
first; conversations with a null id form one; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK = 256
#: Expanded tokens: one for each image patch of so many pixels squared, each so many milliseconds of audio, each page's share.
PATCH, AUDIO_MS, PAGE_TOKENS = 14, 40, 1024
PART = "struct<kind:string,text:string,uri:string,width:int,height:int,millis:long,pages:int>"


def escaped(text: Column) -> Column:
    for raw, mark in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(raw), F.lit(mark))
    return text


def unescaped(text: Column) -> Column:
    for raw, mark in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(mark), F.lit(raw))
    return text


def tokens(part: Column) -> Column:
    """Expanded token count of a part that isn't text."""
    up = lambda x, n: F.ceil(F.coalesce(part[x], F.lit(0)) / F.lit(n)).cast("long")
    return (
        F.when(part["kind"] == "image", up("width", PATCH) * up("height", PATCH))
        .when(part["kind"] == "audio", up("millis", AUDIO_MS))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)).cast("long") * PAGE_TOKENS)
        .otherwise(F.lit(0).cast("long"))
    )


def visited(parts: Column) -> Column:
    """struct<body, attachments>: the flattened message and its attachments in order."""
    is_text = lambda p: F.coalesce(p["kind"], F.lit("text")) == "text"
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    others = F.filter(parts, lambda p: ~is_text(p))
    start = F.struct(F.lit("").alias("body"), F.lit(0).alias("seen"))
    body = F.aggregate(
        parts,
        start,
        lambda acc, p: F.struct(
            F.concat(
                acc["body"],
                F.when(is_text(p), escaped(F.coalesce(p["text"], F.lit("")))).otherwise(
                    F.concat(F.lit("<"), escaped(p["kind"]), F.lit(":"), acc["seen"].cast("string"), F.lit(">"))
                ),
            ).alias("body"),
            (acc["seen"] + F.when(is_text(p), 0).otherwise(1)).alias("seen"),
        ),
        lambda acc: acc["body"],
    )
    attachments = F.transform(
        others,
        lambda p, k: F.struct(k.alias("part"), p["kind"].alias("kind"), p["uri"].alias("uri"), tokens(p).alias("tokens")),
    )
    return F.struct(body.alias("body"), attachments.alias("attachments"))


def text_parts(turns: DataFrame) -> DataFrame:
    """Messages of plain text as one text part each."""
    part = F.struct(
        F.lit("text").alias("kind"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *[
            F.lit(None).cast(t).alias(n) for n, t in (
                ("uri", "string"),
                ("width", "int"),
                ("height", "int"),
                ("millis", "long"),
                ("pages", "int"),
            )
        ],
    )
    return common.project(turns, "conv_id", "turn", "role", "text").select("conv_id", "turn", "role", F.array(part).alias("parts"))


def formatted(turns: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """turns: conv_id, turn, role, parts. Per conversation: conv_id, n_turns, formatted, loss_spans (start,
    chars), attachments (turn, part, kind, uri, tokens), n_attachment_tokens.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit('<turn role="'), escaped(role), F.lit('">'))
    raw = F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), "")  # turns with equal numbers are ordered by it
    turn = common.project(turns, "conv_id", "turn", "role", "parts").select(
        "conv_id",
        "turn",
        role.alias("role"),
        head.alias("head"),
        raw.alias("raw"),
        visited(F.col("parts")).alias("seen"),
    )
    turn = turn.select(
        "conv_id",
        F.expr(f"turn div {BLOCK}").alias("block"),
        F.struct(
            "turn",
            "role",
            "raw",
            F.concat("head", "seen.body", F.lit("</turn>")).alias("out"),
            F.char_length("head").alias("skip"),
            F.char_length("seen.body").alias("chars"),
            F.col("seen.attachments").alias("attachments"),
        ).alias("t"),
    )
    blocks = turn.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    none = "array<struct<start:long,chars:long>>"
    walked = F.aggregate(
        F.col("ts"),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(none).alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.char_length(t["out"])).alias("at"),
            F.when(
                t["role"] == learned_role,
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["skip"]).alias("start"), t["chars"].cast("long").alias("chars")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    refs = F.flatten(
        F.transform(
            "ts",
            lambda t: F.transform(
                t["attachments"],
                lambda a: F.struct(
                    t["turn"].alias("turn"),
                    a["part"].alias("part"),
                    a["kind"].alias("kind"),
                    a["uri"].alias("uri"),
                    a["tokens"].alias("tokens"),
                ),
            ),
        )
    )
    blocks = blocks.select(
        "conv_id",
        "block",
        F.size("ts").cast("long").alias("n"),
        F.array_join(F.transform("ts", lambda t: t["out"]), "").alias("out"),
        walked.alias("walked"),
        refs.alias("refs"),
    )
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "n", "out", "walked", "refs"))).alias("bs"))
    moved = F.aggregate(
        F.col("bs"),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(none).alias("spans")),
        lambda acc, b: F.struct(
            (acc["at"] + b["walked"]["at"]).alias("at"),
            F.concat(
                acc["spans"],
                F.transform(b["walked"]["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["chars"].alias("chars"))),
            ).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    out = whole.select(
        "conv_id",
        F.aggregate("bs", F.lit(0).cast("long"), lambda n, b: n + b["n"]).alias("n_turns"),
        F.array_join(F.transform("bs", lambda b: b["out"]), "").alias("formatted"),
        moved.alias("loss_spans"),
        F.flatten(F.transform("bs", lambda b: b["refs"])).alias("attachments"),
    )
    return out.withColumn("n_attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_back(formats: DataFrame) -> DataFrame:
    """Adds what the output itself says: turns (role, text), parsed from its marks, and loss_text, cut out by the mask."""
    pieces = F.filter(F.split("formatted", "</turn>", -1), lambda p: p != "")
    parsed = F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.substring_index(F.substring_index(p, '">', 1), '<turn role="', -1)).alias("role"),
            unescaped(F.substr(p, F.instr(p, '">') + F.lit(2))).alias("text"),
        ),
    )
    cut = F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["chars"].cast("int"))))
    return formats.withColumn("turns", parsed).withColumn("loss_text", F.array_join(cut, ""))
