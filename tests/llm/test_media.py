import hashlib
import random
import zlib

import numpy as np

from inferweave.llm import media as M


def padded(b):
    return b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))


def payloads():
    r = random.Random(1)
    return [b"\xff" * 576, bytes(range(256)) * 9, bytes(r.randrange(256) for _ in range(5760)), b" " * 1728, padded(b"a longer text with words " * 300), padded("ümläut 日本 ".encode() * 200)]


def scalar_coefficients(data):
    """A plain bit-by-bit reading of a progressive image, after the standard's flow charts."""
    image = M.Image(data)
    coef = [np.zeros((w * h, 64), int) for w, h in image.sizes]
    for comp, first, last, ah, al, restart, spec, pieces in image.scans:
        out = coef[comp]
        if spec:
            code, length = M.codes(spec)
            names = {(int(length[s]), int(code[s])): s for s in np.flatnonzero(length)}
        step = restart or len(out)
        for k, piece in enumerate(pieces):
            bits = "".join(f"{b:08b}" for b in piece.replace(b"\xff\x00", b"\xff"))
            at = 0

            def take(n):
                nonlocal at
                at += n
                return int(bits[at - n : at] or "0", 2)

            def symbol():
                value = 0
                for n in range(1, 17):
                    value = value * 2 + take(1)
                    if (n, value) in names:
                        return names[n, value]
                raise ValueError

            def signed(n):
                v = take(n)
                return v - (1 << n) + 1 if n and v < 1 << (n - 1) else v

            level, run_of_ends = 0, 0
            for b in range(k * step, min((k + 1) * step, len(out))):
                c = out[b]
                if first == 0:
                    if ah:
                        c[0] |= take(1) << al
                    else:
                        level += signed(symbol())
                        c[0] = level << al
                    continue
                i = first

                def refine(j):
                    if take(1):
                        c[j] += (1 if c[j] > 0 else -1) << al

                while run_of_ends == 0 and i <= last:
                    s = symbol()
                    run, size = s >> 4, s & 15
                    if size == 0 and run < 15:
                        run_of_ends = (1 << run) + take(run)
                        break
                    if not ah:
                        i += run
                        if size:
                            c[i] = signed(size) << al
                        i += 1
                        continue
                    value = (1 if take(1) else -1) << al if size else 0
                    while i <= last:
                        if c[i]:
                            refine(i)
                        elif run == 0:
                            c[i] = value
                            i += 1
                            break
                        else:
                            run -= 1
                        i += 1
                if run_of_ends:
                    for j in range(i, last + 1):
                        if ah and c[j]:
                            refine(j)
                    run_of_ends -= 1
    return coef


def test_round_trip_and_scalar_reader():
    p = payloads()
    media = M.encode_payloads(p, [1] * len(p))
    decoded = M.decode_images(media)
    for data, m, (image, coef, rgb) in zip(p, media, decoded, strict=True):
        assert M.read_payload(image, coef) == (1, data)
        assert rgb.shape == (image.height, image.width, 3) and rgb.dtype == np.uint8
    for m, (_, coef, _) in list(zip(media, decoded, strict=True))[:5]:
        assert all((a == b).all() for a, b in zip(coef, scalar_coefficients(m), strict=True))


def test_transform_against_the_definition():
    image = M.Image(M.encode_payloads([b" " * 576], [576])[0])
    coef = [np.zeros((w * h, 64), np.int16) for w, h in image.sizes]
    coef[0][0, 0], coef[0][0, 4], coef[1][0, 0] = 40, -25, 16  # DC, an AC coefficient in zigzag order, blue chroma
    u, v = divmod(int(M.zigzag()[4]), 8)
    c = lambda k: 0.5**0.5 if k == 0 else 1.0
    y = np.array([[40 / 8 - 25 / 4 * c(u) * c(v) * np.cos((2 * r + 1) * u * np.pi / 16) * np.cos((2 * k + 1) * v * np.pi / 16) for k in range(8)] for r in range(8)]) + 128
    y, blue = np.rint(y), 16 / 8
    rgb = np.stack([y, y - 0.344136 * blue, y + 1.772 * blue], axis=2)
    assert np.abs(M.to_rgb(image, coef)[:8, :8] - np.rint(rgb)).max() <= 1


def test_zigzag():
    assert M.zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and M.zigzag()[-1] == 63


def test_operator(spark, documents):
    rows = [(1, "some text " * 100), (2, None), (3, ""), (None, "x"), (5, "some text " * 100), (5, "ü" * 4000)]
    got = M.decode_column(M.encode_column(documents(rows, "media")), tensors=True).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (1, 2, 3):
            b = (dict(rows)[r.doc_id] or "").encode()
            p = padded(b)
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
            assert len(r.rgb) == r.height * r.width * 3
    by = {(r.doc_id, r.n_bytes): r for r in got}
    assert by[1, 1000].media_sha256 == by[5, 1000].media_sha256 and by[2, 0].feature == by[3, 0].feature
    assert M.decode_column(M.encode_column(documents([]))).count() == 0


def other_encoder(seed, width, height, restart=0, sampling=((2, 2), (1, 1), (1, 1)), adobe=None):
    """A progressive image as common encoders write it, with interleaved DC scans and no comment; and its coefficients."""
    r = random.Random(seed)
    hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    sizes = [(-(-width * h // (8 * hmax)), -(-height * v // (8 * vmax))) for h, v in sampling]
    coef = [np.zeros((w * n, 64), np.int16) for w, n in sizes]
    for c in coef:
        c[:, 0], c[:, 1] = [r.randint(-200, 200) for _ in c], [r.choice((-1, 1)) for _ in c]
    order = []  # of the blocks in MCUs: component, place (None: padding)
    for y in range(down):
        for x in range(across):
            order.append([(k, (y * v + j) * sizes[k][0] + x * h + i if y * v + j < sizes[k][1] and x * h + i < sizes[k][0] else None) for k, (h, v) in enumerate(sampling) for j in range(v) for i in range(h)])

    def data(intervals):
        out = []
        for n, bits in enumerate(intervals):
            bits += "1" * (-len(bits) % 8)
            out.append((bytes([0xFF, 0xD0 + (n - 1) % 8]) if n else b"") + bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0"))
        return b"".join(out)

    first, refine = [], []
    for at in range(0, len(order), restart or len(order)):
        a, b, level = "", "", [0] * len(sampling)
        for k, place in (x for mcu in order[at : at + (restart or len(order))] for x in mcu):
            value = int(coef[k][place, 0]) >> 1 if place is not None else level[k] + 3
            d, level[k] = value - level[k], value
            n = abs(d).bit_length()
            a += f"{n:04b}" + (f"{d if d > 0 else d + (1 << n) - 1:0{n}b}" if n else "")
            b += str(int(coef[k][place, 0]) & 1) if place is not None else "1"
        first.append(a)
        refine.append(b)
    tables = bytes([0x00, 0, 0, 0, 12, *[0] * 12, *range(12)]) + bytes([0x10, 0, 2, *[0] * 14, 0x01, 0x00])
    parts = b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(sampling))
    scan = lambda ks, *rest: M.segment(0xDA, bytes([len(ks), *(x for k in ks for x in (k + 1, 0)), *rest]))
    out = [b"\xff\xd8", M.segment(0xDB, b"\0" + b"\1" * 64), M.segment(0xC2, bytes([8, *divmod(height, 256), *divmod(width, 256), len(sampling)]) + parts), b"\xff" + M.segment(0xC4, tables)]
    if adobe is not None:
        out.append(M.segment(0xEE, b"Adobe" + bytes([0, 100, 0, 0, 0, 0, adobe])))
    every = range(len(sampling))
    out += [M.segment(0xDD, bytes(divmod(restart, 256))), scan(every, 0, 0, 0x01), data(first), M.segment(0xDD, b"\0\0")]
    for k in every:
        out += [scan([k], 1, 5, 0x00), data(["".join("00" + ("1" if v > 0 else "0") + "01" for v in coef[k][:, 1])])]
    out += [M.segment(0xDD, bytes(divmod(restart, 256))), scan(every, 0, 0, 0x10), data(refine)]
    return b"".join([*out, b"\xff\xd9"]), coef


OTHERS = [(1, 25, 19), (2, 64, 48, 3), (3, 7, 33, 0, ((2, 1), (1, 1), (1, 1))), (4, 40, 40, 2, ((1, 1),) * 3), (5, 30, 20, 0, ((3, 1), (2, 1), (1, 1))), (6, 17, 17, 0, ((1, 1),) * 3, 0), (7, 17, 17, 0, ((1, 1),) * 4, 2)]


def test_images_of_other_encoders():
    made = [other_encoder(*x) for x in OTHERS]
    own = M.encode_payloads([b"abc" * 192], [576])
    got = M.decode_images([m for m, _ in made] + own)
    for (_, want), (image, coef, rgb), x in zip(made, got, OTHERS, strict=False):
        assert all((a == b).all() for a, b in zip(coef, want, strict=True)) and rgb.shape == (x[2], x[1], 3)
        assert M.read_payload(image, coef) is None
    assert M.read_payload(*got[-1][:2]) == (576, b"abc" * 192)
    image, coef, rgb = got[5]  # stored as RGB
    for k in range(3):
        assert abs(float(rgb[:8, :8, k].mean()) - min(255, max(0, 128 + coef[k][0, 0] / 8))) < 1


def test_column_of_other_images_and_null(spark):
    made = [(i, other_encoder(*x)[0]) for i, x in enumerate(OTHERS)]
    got = {r.doc_id: r for r in M.decode_column(spark.createDataFrame([*((i, bytearray(m)) for i, m in made), (99, None)], "doc_id long, media binary"), tensors=True).collect()}
    assert len(got) == len(made) + 1 and [*got[99]][1:] == [None] * 10
    for i, m in made:
        r = got[i]
        assert (r.n_bytes, r.payload_sha256, r.media_bytes, r.media_sha256) == (None, None, len(m), hashlib.sha256(m).hexdigest())
        assert (r.width, r.height) == OTHERS[i][1:3] and len(r.rgb) == 3 * r.width * r.height and r.feature.startswith(f"{r.width}x{r.height};")
