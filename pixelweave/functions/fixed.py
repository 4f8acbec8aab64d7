"""Tables of the codec, and dimension rows built from them."""

from __future__ import annotations

import math

import numpy as np

# Fixed values, in natural order: base quantization steps of an 8x8 block, and weights of contrast sensitivity.
LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]
GENTLE_CHROMA = [
    17, 18, 20, 24, 30, 38, 48, 60, 18, 20, 22, 28, 36, 45, 56, 68, 20, 22, 26, 32, 42, 52, 64, 76, 24, 28, 32, 40, 50, 62, 74, 86,
    30, 36, 42, 50, 60, 72, 84, 96, 38, 45, 52, 62, 72, 84, 96, 99, 48, 56, 64, 74, 84, 96, 99, 99, 60, 68, 76, 86, 96, 99, 99, 99,
]
CSF = [
    1.0, 0.98, 0.93, 0.85, 0.75, 0.63, 0.52, 0.42, 0.98, 0.95, 0.88, 0.78, 0.67, 0.55, 0.45, 0.36, 0.93, 0.88, 0.80, 0.70, 0.59, 0.48, 0.39, 0.31,
    0.85, 0.78, 0.70, 0.60, 0.50, 0.41, 0.33, 0.26, 0.75, 0.67, 0.59, 0.50, 0.42, 0.34, 0.27, 0.22, 0.63, 0.55, 0.48, 0.41, 0.34, 0.28, 0.22, 0.18,
    0.52, 0.45, 0.39, 0.33, 0.27, 0.22, 0.18, 0.14, 0.42, 0.36, 0.31, 0.26, 0.22, 0.18, 0.14, 0.11,
]
# The rows of the integer transform.
INT_ROWS = [
    [64, 64, 64, 64, 64, 64, 64, 64],
    [89, 75, 50, 18, -18, -50, -75, -89],
    [83, 36, -36, -83, -83, -36, 36, 83],
    [75, -18, -89, -50, 50, 89, 18, -75],
    [64, -64, -64, 64, 64, -64, -64, 64],
    [50, -89, 18, 75, -75, -18, 89, -50],
    [36, -83, 83, -36, -36, 83, -83, 36],
    [18, -50, 75, -89, 89, -75, 50, -18],
]
# Colour matrices; limited ranges are (offset, per-255 weights) and chroma back-weights.
COLOR = {
    "full": ((0.0, 0.299, 0.587, 0.114), (128.0, -0.168736, -0.331264, 0.5), (128.0, 0.5, -0.418688, -0.081312), (1.402, -0.344136, -0.714136, 1.772)),
    "601": ((16.0, 65.481, 128.553, 24.966), (128.0, -37.797, -74.203, 112.0), (128.0, 112.0, -93.786, -18.214), (1.402, -0.344136, -0.714136, 1.772)),
    "709": ((16.0, 46.742, 157.243, 15.874), (128.0, -25.765, -86.674, 112.439), (128.0, 112.439, -102.129, -10.310), (1.5748, -0.1873, -0.4681, 1.8556)),
    "2020": ((16.0, 46.559, 156.629, 16.812), (128.0, -25.494, -85.723, 111.217), (128.0, 111.217, -101.370, -9.847), (1.4746, -0.1646, -0.5714, 1.8814)),
}
# Transfer curves, scan bands (first index of each), progressive low AC, tokens (least magnitude of each class).
PQ = (0.1593017578125, 78.84375, 0.8359375, 18.8515625, 18.6875)
HLG = (0.17883277, 0.28466892, 0.55991073)
BANDS_8, BANDS_4 = (0, 1, 4, 7, 11, 16, 25, 40), (0, 1, 2, 4, 6, 9, 12, 14)
LOW_AC = (1, 2, 3, 8, 9, 10, 16, 17, 18, 24, 25, 32, 33, 40, 48)
TOKENS = (("Zero", 0, 0), ("One", 1, 0), ("Two", 2, 0), ("Three", 3, 0), ("Four", 4, 0), ("Cat1", 5, 1), ("Cat2", 7, 2), ("Cat3", 11, 3), ("Cat4", 19, 4), ("Cat5", 35, 5), ("Cat6", 67, 11))
MODES = ("DC", "Horizontal", "Vertical", "DownLeft", "DownRight", "VerticalRight", "HorizontalDown", "VerticalLeft", "HorizontalUp", "Planar", "TrueMotion")
CHUNKS = (b"IHDR", b"ICCP", b"EXIF", b"XMP\0", b"THUM", b"ANIM", b"IDAT", b"IDLS", b"FRMD", b"CUST", b"IEND")
MAGIC = b"WK3.0\0\0\0"


def zigzag(n: int = 8) -> list[int]:
    """Raster index at each place of the diagonal scan."""
    cells = sorted(((y, x) for y in range(n) for x in range(n)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return [y * n + x for y, x in cells]


def basis(n: int = 8) -> np.ndarray:
    """Rows u, columns x of the orthonormal cosine transform."""
    u, x = np.mgrid[:n, :n]
    b = np.cos((2 * x + 1) * u * np.pi / (2 * n)) * math.sqrt(2 / n)
    b[0] /= math.sqrt(2)
    return b


def int_basis() -> np.ndarray:
    return np.array(INT_ROWS, np.int64)


def steps(quality: int, chroma: bool, kind: str = "adaptive") -> list[int]:
    """The 64 quantization steps of a kind: adaptive, aggressive, size, csf, legacy or lossless."""
    if kind == "lossless":
        return [1] * 64
    base = (GENTLE_CHROMA if kind in ("adaptive",) and quality >= 80 else CHROMA) if chroma else LUMA
    q = max(1, min(100, quality))
    scale = 5000 // q if q < 50 else 200 - 2 * q
    if kind == "aggressive":
        scale = scale * 11 // 10 if q < 50 else max(15, scale * 11 // 10)
    elif kind == "size":
        scale = max(15, scale * 115 // 100)
    elif kind == "csf":
        base = csf_base(chroma)
    return [max(1, min(255, (b * scale + 50) // 100)) for b in base]


def csf_base(chroma: bool) -> list[int]:
    factor = np.float32(1) + (np.float32(1) - np.array(CSF, np.float32)) * np.float32(0.5)
    return (np.array(CHROMA if chroma else LUMA, np.float32) * factor).astype(int).tolist()


def deblock_row(q: int) -> tuple[int, int, int, bool, bool]:
    """(strength, edge threshold, sharpness, simple, enabled) at a quality."""
    strength = 40 if q < 70 else 28 if q < 80 else 18 if q < 85 else 10 if q < 90 else 6 if q < 95 else 3
    edge = 20 if q < 80 else 15 if q < 90 else 10
    return strength, edge, 3 if q < 80 else 5 if q < 90 else 6, q >= 92, q < 97


# Probabilities (of 256, of a zero) of the token tree: end of block, a step up the ladder of classes, extra bits of classes 5 to 10.
END_PROB = 252
CLASS_PROBS = (180, 165, 145, 140, 135, 128, 128, 128, 128, 128)
EXTRA_PROBS = {5: (159,), 6: (165, 145), 7: (173, 148, 140), 8: (176, 155, 140, 135), 9: (180, 157, 141, 134, 130), 10: (254, 254, 243, 230, 196, 177, 153, 140, 133, 130, 129)}
# Adaptive probabilities of the first block type, bands 1 to 7, at nodes 0 and 3, by context. All others are 128.
BAND_PROBS = {
    0: ((176, 167, 154), (186, 177, 166), (190, 183, 175), (193, 188, 182), (195, 191, 186), (197, 194, 190), (199, 196, 193)),
    3: ((167, 154, 141), (177, 166, 154), (183, 175, 166), (188, 182, 175), (191, 186, 181), (194, 190, 185), (196, 193, 189)),
}
BLOCK_TYPES = ("Y1", "Y2", "UV", "Y1AC")
# Colour profiles (name, space, intent, profile name, description), Exif tags, marker.
ICC = (
    ("srgb", "SRGB", "Perceptual", "sRGB IEC61966-2.1", "sRGB color space profile"),
    ("adobe_rgb", "AdobeRGB", "RelativeColorimetric", "Adobe RGB (1998)", "Adobe RGB color space profile"),
    ("display_p3", "DisplayP3", "Perceptual", "Display P3", "Apple Display P3 color space"),
    ("prophoto_rgb", "ProPhotoRGB", "RelativeColorimetric", "ProPhoto RGB", "ProPhoto RGB color space for wide gamut"),
    ("rec2020", "Rec2020", "Perceptual", "ITU-R BT.2020", "Rec. 2020 HDR color space"),
    ("raw", "Custom", "Perceptual", "Custom ICC Profile", "Embedded ICC profile"),
)
EXIF_TAGS = (
    "Make", "Model", "Software", "DateTime", "DateTimeOriginal", "ExposureTime", "FNumber", "ISOSpeedRatings", "FocalLength", "FocalLengthIn35mm", "LensModel", "Artist", "Copyright", "ImageDescription", "Orientation",
    "XResolution", "YResolution", "GPSLatitude", "GPSLongitude", "GPSAltitude", "ImageWidth", "ImageHeight", "WhiteBalance", "Flash", "MeteringMode", "ExposureProgram", "ExposureBiasValue", "ColorSpace",
)
RESYNC = b"\xff\xd0\0\0"
# Presets of high dynamic range (name, bit depth, transfer, gamut, greatest light level of content, of a frame's mean).
HDR = (("sdr", 8, "SDR", "SRGB", None, None), ("hdr10", 10, "PQ", "Rec2020", 1000, 400), ("hlg", 10, "HLG", "Rec2020", None, None))


def probability(block_type: int, band: int, context: int, node: int) -> int:
    """The default probability at a place of the coefficient table; indices past the end are the last ones."""
    band, node = min(band, 7), min(node, 10)
    if block_type or not band or node not in BAND_PROBS:
        return 128
    return BAND_PROBS[node][band - 1][context]


class Probabilities:
    """Coefficient probabilities that can be set; places as in `probability`."""

    def __init__(self):
        self.reset()

    def get(self, block_type: int, band: int, context: int, node: int) -> int:
        return self.own.get((block_type, min(band, 7), context, min(node, 10)), probability(block_type, band, context, node))

    def set(self, block_type: int, band: int, context: int, node: int, p: int) -> None:
        self.own[block_type, min(band, 7), context, min(node, 10)] = p

    def reset(self) -> None:
        self.own: dict[tuple[int, int, int, int], int] = {}
