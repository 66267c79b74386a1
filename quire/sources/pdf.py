"""PDF files of images, one a page, with the standard library: JPEG and plain PNG data are embedded as they are; PNG with
transparency or interlace, GIF and uncompressed BMP are decoded first."""

from __future__ import annotations

import struct
import zlib

#: Pixels an inch.
RESOLUTION = 100.0


def _jpeg(data: bytes) -> tuple[int, int, str, bytes]:
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker = data[at + 1]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            bits, height, width, parts = struct.unpack(">BHHB", data[at + 4 : at + 10])
            space = {1: "/DeviceGray", 3: "/DeviceRGB", 4: "/DeviceCMYK"}[parts]
            invert = " /Decode [1 0 1 0 1 0 1 0]" if parts == 4 else ""
            return width, height, f"/ColorSpace {space} /BitsPerComponent {bits} /Filter /DCTDecode{invert}", data
        at += 2 if marker == 0xFF or 0xD0 <= marker <= 0xD9 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    raise ValueError("no frame in a JPEG")


def _rgb(width: int, height: int, pixels: bytes) -> tuple[int, int, str, bytes]:
    return width, height, "/ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode", zlib.compress(pixels)


def _unfilter(raw: bytes, rows: int, width: int, bpp: int) -> list[bytearray]:
    out, before = [], bytearray(width)
    for y in range(rows):
        kind, line = raw[y * (width + 1)], bytearray(raw[y * (width + 1) + 1 : (y + 1) * (width + 1)])
        for x in range(width):
            a, b, c = line[x - bpp] if x >= bpp else 0, before[x], before[x - bpp] if x >= bpp else 0
            if kind == 1:
                line[x] = line[x] + a & 255
            elif kind == 2:
                line[x] = line[x] + b & 255
            elif kind == 3:
                line[x] = line[x] + (a + b >> 1) & 255
            elif kind == 4:
                p = a + b - c
                best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))
                line[x] = line[x] + best[2] & 255
        out.append(line)
        before = line
    return out


#: First column and row, and steps between them, of the seven passes of an interlaced PNG.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _samples(line: bytes, width: int, bits: int) -> list[bytes]:
    """The pixels of a line: their bytes, or a byte for each where several share one."""
    if bits >= 8:
        return [line[x : x + bits // 8] for x in range(0, width * bits // 8, bits // 8)]
    return [bytes([line[x * bits // 8] >> 8 - bits - x * bits % 8 & (1 << bits) - 1]) for x in range(width)]


def _deinterlaced(raw: bytes, width: int, height: int, bits: int) -> list[bytes]:
    """The lines of a picture of so many bits a pixel, put together from its passes."""
    rows = [[b"\0" * max(1, bits // 8)] * width for _ in range(height)]
    at = 0
    for left, top, step_x, step_y in PASSES:
        w, h = -(-(width - left) // step_x), -(-(height - top) // step_y)
        if w <= 0 or h <= 0:
            continue
        size = (w * bits + 7) // 8
        for k, line in enumerate(_unfilter(raw[at : at + h * (size + 1)], h, size, max(1, bits // 8))):
            rows[top + k * step_y][left::step_x] = _samples(bytes(line), w, bits)
        at += h * (size + 1)
    if bits >= 8:
        return [b"".join(r) for r in rows]
    packed = []
    for r in rows:
        number = 0
        for v in r:
            number = number << bits | v[0]
        size = (width * bits + 7) // 8
        packed.append((number << size * 8 - width * bits).to_bytes(size, "big"))
    return packed


def _png(data: bytes) -> tuple[int, int, str, bytes]:
    at, parts, palette, header = 8, [], b"", b""
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            header = body
        elif kind == b"PLTE":
            palette = body
        elif kind == b"IDAT":
            parts.append(body)
    width, height, bits, color, _, _, interlace = struct.unpack(">IIBBBBB", header)
    packed = b"".join(parts)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    lines = _deinterlaced(zlib.decompress(packed), width, height, bits * channels) if interlace else None
    if color in (0, 2, 3):
        space = {0: "/DeviceGray", 2: "/DeviceRGB", 3: f"[/Indexed /DeviceRGB {len(palette) // 3 - 1} <{palette.hex()}>]"}[color]
        if lines is not None:
            return width, height, f"/ColorSpace {space} /BitsPerComponent {bits} /Filter /FlateDecode", zlib.compress(b"".join(lines))
        return width, height, f"/ColorSpace {space} /BitsPerComponent {bits} /Filter /FlateDecode /DecodeParms << /Predictor 15 /Colors {channels} /BitsPerComponent {bits} /Columns {width} >>", packed
    step = bits // 8
    lines = lines or _unfilter(zlib.decompress(packed), height, width * channels * step, channels * step)
    pixels = bytearray()
    for line in lines:  # on white
        line = line[::step]
        for x in range(0, len(line), channels):
            alpha = line[x + channels - 1]
            shades = line[x : x + 1] * 3 if channels == 2 else line[x : x + 3]
            pixels += bytes((v * alpha + 255 * (255 - alpha)) // 255 for v in shades)
    return _rgb(width, height, bytes(pixels))


def _gif(data: bytes) -> tuple[int, int, str, bytes]:
    """The first frame, on white."""
    width, height, flags = struct.unpack("<HHB", data[6:11])
    at, table = 13, b""
    if flags & 128:
        size = 3 << (flags & 7) + 1
        table, at = data[at : at + size], at + size
    clear = None
    while data[at] != 0x2C:
        if data[at] == 0x3B:
            raise ValueError("no frame in a GIF")
        if data[at + 1] == 0xF9 and data[at + 3] & 1:
            clear = data[at + 6]
        at += 2
        while data[at]:
            at += 1 + data[at]
        at += 1
    left, top, w, h, own = struct.unpack("<HHHHB", data[at + 1 : at + 10])
    at += 10
    if own & 128:
        size = 3 << (own & 7) + 1
        table, at = data[at : at + size], at + size
    least, packed = data[at], bytearray()
    at += 1
    while data[at]:
        packed += data[at + 1 : at + 1 + data[at]]
        at += 1 + data[at]
    indices = _lzw(bytes(packed), least)
    rows = list(range(h))
    if own & 64:
        rows = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
    pixels = bytearray(b"\xff" * (width * height * 3))
    for k, y in enumerate(rows):
        for x in range(w):
            i = indices[k * w + x] if k * w + x < len(indices) else clear
            if i is not None and i != clear and top + y < height and left + x < width:
                to = ((top + y) * width + left + x) * 3
                pixels[to : to + 3] = table[3 * i : 3 * i + 3]
    return _rgb(width, height, bytes(pixels))


def _lzw(packed: bytes, least: int) -> bytes:
    clear, end = 1 << least, (1 << least) + 1
    table: list[bytes] = []
    out, size, last, held, bits = bytearray(), least + 1, b"", 0, 0
    for byte in packed:
        held |= byte << bits
        bits += 8
        while bits >= size:
            code, held, bits = held & (1 << size) - 1, held >> size, bits - size
            if code == clear or not table:
                table = [bytes([i]) for i in range(clear)] + [b"", b""]
                size, last = least + 1, b""
                if code == clear:
                    continue
            if code == end:
                return bytes(out)
            word = table[code] if code < len(table) else last + last[:1]
            out += word
            if last and len(table) < 4096:
                table.append(last + word[:1])
                if len(table) == 1 << size and size < 12:
                    size += 1
            last = word
    return bytes(out)


def _bmp(data: bytes) -> tuple[int, int, str, bytes]:
    start, head, width, height, _, bits, packing = struct.unpack("<IIiiHHI", data[10:34])
    if packing not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits is supported")
    step, stride = bits // 8, (width * bits + 31) // 32 * 4
    pixels = bytearray()
    for y in range(abs(height)):
        row = data[start + (abs(height) - 1 - y if height > 0 else y) * stride :][: width * step]
        for x in range(0, width * step, step):
            at = 14 + head + 4 * row[x]
            pixels += (data[at : at + 3] if step == 1 else row[x : x + 3])[::-1]
    return _rgb(width, abs(height), bytes(pixels))


def image(data: bytes) -> tuple[int, int, str, bytes]:
    """Width, height, the stream's entries and its bytes."""
    for start, read in ((b"\xff\xd8", _jpeg), (b"\x89PNG", _png), (b"GIF8", _gif), (b"BM", _bmp)):
        if data.startswith(start):
            return read(data)
    raise ValueError("not a JPEG, PNG, GIF or BMP image")


def write(images: list[bytes]) -> bytes:
    """A PDF with an image a page."""
    objects: list[bytes] = [b"", b""]
    pages = []
    for data in images:
        width, height, entries, stream = image(data)
        w, h = width * 72 / RESOLUTION, height * 72 / RESOLUTION
        n = len(objects) + 1
        draw = f"q {w:.2f} 0 0 {h:.2f} 0 0 cm /I Do Q".encode()
        objects.append(f"<< /Type /XObject /Subtype /Image /Width {width} /Height {height} {entries} /Length {len(stream)} >>\nstream\n".encode() + stream + b"\nendstream")
        objects.append(f"<< /Length {len(draw)} >>\nstream\n".encode() + draw + b"\nendstream")
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {w:.2f} {h:.2f}] /Resources << /XObject << /I {n} 0 R >> >> /Contents {n + 1} 0 R >>".encode())
        pages.append(f"{n + 2} 0 R")
    objects[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[1] = f"<< /Type /Pages /Kids [{' '.join(pages)}] /Count {len(pages)} >>".encode()
    out, places = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n".encode() + body + b"\nendobj\n"
    table = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
    return bytes(out + f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{table}\n%%EOF\n".encode())
