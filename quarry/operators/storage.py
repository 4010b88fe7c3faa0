"""Key-value and cell tables, link tables, and content addresses, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_writes(log: DataFrame, key: str = "key", seq: str = "seq", upto: int | None = None) -> DataFrame:
    """The state after a log of (key, seq, op, value) up to a sequence number: the last op of each key wins; deletes drop it."""
    seen = log if upto is None else log.where(F.col(seq) <= upto)
    last = seen.groupBy(key).agg(F.max_by(F.struct("op", "value"), seq).alias("x"))
    return last.where("x.op = 'put'").select(key, "x.value")


def key_range(table: DataFrame, start: str | None, end: str | None, key: str = "key") -> DataFrame:
    """Keys from start up to but without end, in order; None is open."""
    out = table
    if start is not None:
        out = out.where(F.col(key) >= start)
    if end is not None:
        out = out.where(F.col(key) < end)
    return out.orderBy(key)


def prefix_end(prefix: bytes) -> bytes | None:
    """The least key after all that begin with prefix; None where there is none."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


CELL = ("row", "family", "qualifier")


def newest_cells(cells: DataFrame, keep: int = 1) -> DataFrame:
    """The newest `keep` versions of each cell; below 1 is 1. A version written twice counts once."""
    versions = cells.dropDuplicates([*CELL, "ts"])
    order = Window.partitionBy(*CELL).orderBy(F.desc("ts"))
    return versions.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max(keep, 1)).drop("_n")


def latest_cells(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*CELL).agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))


def ordered_key(row: bytes, family: int, qualifier: bytes, ts: int) -> bytes:
    """A byte key that sorts by row, family, qualifier, then newest first: zeros are escaped, times inverted."""
    framed = lambda x: x.replace(b"\x00", b"\x00\xff") + b"\x00\x00"
    return framed(row) + bytes([family]) + framed(qualifier) + (~ts & (1 << 64) - 1).to_bytes(8, "big")


def split_ordered_key(key: bytes) -> tuple[bytes, int, bytes, int]:
    def take(at: int) -> tuple[bytes, int]:
        out = bytearray()
        while key[at : at + 2] != b"\x00\x00":
            out.append(key[at])
            at += 2 if key[at] == 0 else 1
        return bytes(out), at + 2

    row, at = take(0)
    family = key[at]
    qualifier, at = take(at + 1)
    ts = ~int.from_bytes(key[at:], "big") & (1 << 64) - 1
    return row, family, qualifier, ts - (1 << 64) if ts >> 63 else ts


def reversed_host(host: Column) -> Column:
    """Lower case, one trailing dot dropped, labels reversed."""
    return F.array_join(F.reverse(F.split(F.regexp_replace(F.lower(host), r"\.$", ""), r"\.")), ".")


def last_links(links: DataFrame) -> DataFrame:
    """src, dst, anchor: the last write of each edge."""
    return links.groupBy("src", "dst").agg(F.max_by("anchor", "seq").alias("anchor"))


def address(data: Column) -> Column:
    return F.sha2(data, 256)


KINDS = ("warc", "wat", "wet", "ciff", "webgraph", "embeddings")


def signing_bytes(kind: Column, snapshot: Column, content_hex: Column, operator: Column) -> Column:
    """Kind byte, snapshot, 32 address bytes, operator, without delimiters."""
    return F.concat(F.unhex(F.lpad(F.hex(kind.cast("long")), 2, "0")), F.encode(snapshot, "utf-8"), F.unhex(content_hex), F.encode(operator, "utf-8"))


def verify_status(artifacts: DataFrame, registry: DataFrame) -> DataFrame:
    """status of (content, rebuilt, signed, operator): what fails first among operator, signature, rebuilt hash."""
    joined = artifacts.join(registry.select("operator", F.lit(True).alias("known")), "operator", "left")
    status = F.when(F.col("known").isNull(), "unknown operator").when(~F.col("signed"), "bad signature").when(F.col("rebuilt") != F.col("content"), "hash mismatch").otherwise("ok")
    return joined.withColumn("status", status).drop("known")


def sign(spark, seed: bytes, message: bytes) -> tuple[bytes, bytes]:
    """(public key, signature) of Ed25519 by the JVM's own provider."""
    jvm = spark.sparkContext._jvm
    spec = jvm.java.security.spec.NamedParameterSpec("Ed25519")
    factory = jvm.java.security.KeyPairGenerator.getInstance("Ed25519")
    random = jvm.java.security.SecureRandom.getInstance("SHA1PRNG")
    random.setSeed(bytearray(seed))
    factory.initialize(spec, random)
    pair = factory.generateKeyPair()
    signer = jvm.java.security.Signature.getInstance("Ed25519")
    signer.initSign(pair.getPrivate())
    signer.update(bytearray(message))
    # through the key factory: the provider's own key classes aren't open to reflection
    form = jvm.java.lang.Class.forName("java.security.spec.X509EncodedKeySpec")
    public = jvm.java.security.KeyFactory.getInstance("Ed25519").getKeySpec(pair.getPublic(), form)
    return bytes(public.getEncoded()), bytes(signer.sign())


def signature_holds(spark, public: bytes, message: bytes, signature: bytes) -> bool:
    jvm = spark.sparkContext._jvm
    key = jvm.java.security.KeyFactory.getInstance("Ed25519").generatePublic(jvm.java.security.spec.X509EncodedKeySpec(bytearray(public)))
    check = jvm.java.security.Signature.getInstance("Ed25519")
    check.initVerify(key)
    check.update(bytearray(message))
    return bool(check.verify(bytearray(signature)))
