"""Colour sets of dyed items. Fixed values of the market's rules."""

from __future__ import annotations

# Colour sets, as hexadecimal codes.
SPOOK = """
000000 070008 0E000F 150017 1B001F 220027 29002E 300036 37003E 3E0046 45004D 4C0055 52005D 590065 60006C 670074
6E007C 750084 7C008B 830093 89009B 9000A3 9700AA 993399 9E00B2
""".split()
CRYSTAL = """
1F0030 46085E 54146E 5D1C78 63237D 6A2C82 7E4196 8E51A6 9C64B3 A875BD B88BC9 C6A3D4 D9C1E3 E5D1ED EFE1F5 FCF3FF
""".split()
FAIRY = """
330066 4C0099 660033 660066 6600CC 7F00FF 99004C 990099 9933FF B266FF CC0066 CC00CC CC99FF E5CCFF FF007F FF00FF
FF3399 FF33FF FF66B2 FF66FF FF99CC FF99FF FFCCE5 FFCCFF
""".split()
OG_FAIRY = """
FF99FF FFCCFF E5CCFF CC99FF CC00CC FF00FF FF33FF FF66FF B266FF 9933FF 7F00FF 660066 6600CC 4C0099 330066 990099
""".split()
# Further first-edition fairy colours by the piece they are on, looked up in this order.
OG_FAIRY_PIECES = [
    ("BOOTS", ["660033", "99004C", "CC0066"]),
    ("LEGGINGS", ["660033", "99004C", "FFCCE5"]),
    ("CHESTPLATE", ["660033", "FFCCE5", "FF99CC"]),
    ("HELMET", ["FFCCE5", "FF99CC", "FF66B2"]),
]
# Items that come in any colour.
ANY_COLOR_ITEMS = ["GHOST_BOOTS", "VELVET_TOP_HAT", "CASHMERE_JACKET", "SATIN_TROUSERS", "OXFORD_SHOES"]
# Items with several original colours.
ADAPTIVE_CHEST = ["3ABE78", "82E3D8", "BFBCB2", "D579FF", "FF4242", "FFC234"]
ADAPTIVE_REST = ["169F57", "2AB5A5", "6E00A0", "BB0000", "BFBCB2", "FFF7E6"]
VARIANTS = {
    "RANCHERS_BOOTS": ["CC5500", "000000"],
    "REAPER_BOOTS": ["1B1B1B", "FF0000"],
    "REAPER_LEGGINGS": ["1B1B1B", "FF0000"],
    "REAPER_CHESTPLATE": ["1B1B1B", "FF0000"],
    "STARRED_ADAPTIVE_CHESTPLATE": ADAPTIVE_CHEST,
    "ADAPTIVE_CHESTPLATE": ADAPTIVE_CHEST,
    "STARRED_ADAPTIVE_LEGGINGS": ADAPTIVE_REST,
    "ADAPTIVE_LEGGINGS": ADAPTIVE_REST,
    "STARRED_ADAPTIVE_BOOTS": ADAPTIVE_REST,
    "ADAPTIVE_BOOTS": ADAPTIVE_REST,
    "KUUDRA_FOLLOWER_CHESTPLATE": ["35530A"],
    "KUUDRA_FOLLOWER_LEGGINGS": ["35530A"],
    "KUUDRA_FOLLOWER_BOOTS": ["35530A"],
}
# Colours an item family got by a fault, and the undyed code.
GLITCHED = {"FFDC51": "SHARK_SCALE", "F7DA33": "FROZEN_BLAZE", "606060": "BAT_PERSON"}
UNDYED = ["A06540", "UNDYED"]
