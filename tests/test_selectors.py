"""Selectors against a plain walk over the tree, prefixes against startswith, and interlaced pictures against plain ones."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quire.operators import elements, prefixes, selectors
from quire.sources import pdf

PAGE = """<div id="top" class="box wide"><ul><li class="x">1</li><li lang="en-US" data-k="abc">2<b>deep</b></li><li class="x y"></li></ul>
<p class="x">a</p><p>b</p><span>c</span><p class="y" data-k="">d</p><div><p id="in">e<i>f</i></p></div></div><p class="x">after</p>"""


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("p", "abde after f"),
        ("*", None),
        ("#in", "ef"),
        ("p.x", "a,after"),
        (".x.y", ""),
        ("div > p", "a,b,d,ef"),
        ("#top p", "a,b,d,ef"),
        ("#top > p", "a,b,d"),
        ("div div p > i", "f"),
        ("p.x + p", "b"),
        ("p ~ p", "b,d"),
        ("div ~ p", "after"),
        ("ul ~ p.y", "d"),
        ("li:first-child", "1"),
        ("li:last-child", ""),
        ("li:nth-child(2)", "2deep"),
        ("li:nth-child(odd)", "1,"),
        ("li:nth-child(-n+2)", "1,2deep"),
        ("p:nth-child(2n+1)", "b,d,ef"),
        ("[data-k]", "2deep,d"),
        ("[data-k=abc]", "2deep"),
        ("[data-k^='ab']", "2deep"),
        ('[data-k$="bc"]', "2deep"),
        ("[data-k*=b]", "2deep"),
        ("[data-k*='']", None),
        ("[lang|=en]", "2deep"),
        ("[class~=y]", ",d"),
        ("p:not(.x)", "b,d,ef"),
        ("p:not(.x, [data-k])", "b,ef"),
        ("li:empty, i", ",f"),
        ("ul>li.x,span", "1,,c"),
        ("body p", None),
    ],
)
def test_selectors(spark, selector, want):
    df = elements.parse(spark.createDataFrame([(1, PAGE)], "id int, html string"))
    got = [r["text"] for r in df.select(selectors.select("elements", selector).alias("e")).first()["e"]]
    if selector == "*":
        assert len(got) == 14
    elif want is None:
        assert got == []
    elif selector == "p":
        assert got == ["a", "b", "d", "ef", "after"]
    elif selector == ".x.y":
        assert got == [""]
    else:
        assert got == want.split(",")


@pytest.mark.parametrize("selector", ["", "p >", "p:hover", "a,,b", "li:nth-child(x)"])
def test_what_is_no_selector_raises(selector):
    with pytest.raises(ValueError):
        selectors.compiled(selector)


def test_longest_prefix_of_many(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    table = spark.createDataFrame([(w,) for w in words[:150]] + [(None,)] + [(f"no-{i}",) for i in range(5000)], "prefix string")
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(-1, None), (-2, "")], "own int, url string")
    got = {r["own"]: r["hit"] for r in prefixes.longest_prefix(rows, "url", table, name="hit").collect()}
    assert got == {i: max((p for p in words[:150] if w.startswith(p)), key=len, default=None) for i, w in enumerate(words)} | {-1: None, -2: None}
    assert {r["own"] for r in prefixes.not_blocked(rows, "url", table).collect()} == {i for i, v in got.items() if v is None}
    assert prefixes.not_blocked(rows, "url", table.limit(0)).count() == len(words) + 2
    size = lambda n: len(prefixes.longest_prefix(rows, "url", table.where(F.length("prefix") < 8).limit(n), name="hit")._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(300) - size(3000)) < 600  # lengths alone make the plan


def chunk(kind, body):
    return struct.pack(">I4s", len(body), kind) + body + struct.pack(">I", zlib.crc32(kind + body))


def png(pixels, bits, color, interlace):
    """pixels: rows of pixels, each a list of samples."""
    height, width = len(pixels), len(pixels[0])

    def packed(rows):
        out = b""
        for y, row in enumerate(rows):
            text = "".join(f"{v:0{bits}b}" for p in row for v in p)
            line = int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")
            kind, step = (2, 0) if y % 2 else (1, max(1, bits * len(row[0]) // 8))
            before = packed.before if y and kind == 2 else bytes(len(line))
            out += bytes([kind]) + bytes((v - (before[i] if kind == 2 else line[i - step] if i >= step else 0)) & 255 for i, v in enumerate(line))
            packed.before = line
        return out

    if interlace:
        raw = b""
        for x, y, dx, dy in ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)):
            rows = [r[x::dx] for r in pixels[y::dy]]
            if rows and rows[0]:
                raw += packed(rows)
    else:
        raw = packed(pixels)
    plte = chunk(b"PLTE", bytes(range(3 << bits)) if bits < 8 else bytes(i % 256 for i in range(768))) if color == 3 else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, color, 0, 0, int(interlace))) + plte + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize(("color", "bits"), [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 4), (3, 8), (4, 8), (6, 8), (6, 16)])
def test_interlaced_pictures_are_the_plain_ones(color, bits):
    rng = random.Random(bits)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    for width, height in ((1, 1), (3, 2), (8, 8), (13, 9), (5, 17)):
        pixels = [[[rng.randrange(1 << bits) for _ in range(channels)] for _ in range(width)] for _ in range(height)]
        whole = pdf.image(png(pixels, bits, color, True))
        plain = pdf.image(png(pixels, bits, color, False))
        assert whole[:2] == plain[:2] == (width, height)
        if color in (4, 6):
            assert zlib.decompress(whole[3]) == zlib.decompress(plain[3])
            continue
        size = (width * bits * channels + 7) // 8
        lines = pdf._unfilter(zlib.decompress(plain[3]), height, size, max(1, bits * channels // 8))
        assert zlib.decompress(whole[3]) == b"".join(map(bytes, lines))
        assert whole[2].split(" /Filter")[0] == plain[2].split(" /Filter")[0]
