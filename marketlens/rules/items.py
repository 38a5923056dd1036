"""Item rules. All tables below are fixed values of the market's rules."""

from __future__ import annotations

# Tiers in their order, with the number they are compared by.
TIERS = {
    "UNKNOWN": 0, "COMMON": 1, "UNCOMMON": 2, "RARE": 3, "EPIC": 4, "LEGENDARY": 5, "SPECIAL": 6,
    "VERY_SPECIAL": 7, "MYTHIC": 8, "DIVINE": 9, "ULTIMATE": 10,
}

# What is looked for in a description line, first hit wins.
TIER_WORDS = [
    ("LEGENDARY", "LEGENDARY"), ("UNCOMMON", "UNCOMMON"), ("COMMON", "COMMON"), ("RARE", "RARE"), ("EPIC", "EPIC"),
    ("MYTHIC", "MYTHIC"), ("VERY SPECIAL", "VERY_SPECIAL"), ("SPECIAL", "SPECIAL"), ("UNKNOWN", "UNKNOWN"),
    ("DIVINE", "DIVINE"), ("ULTIMATE", "ULTIMATE"), ("SUPREME", "DIVINE"),
]
# Tier by the colour code a name starts with.
TIER_COLORS = {"§c": "SPECIAL", "§4": "ULTIMATE", "§b": "DIVINE"}

# The reforge names.
REFORGES = """
None Demonic Forceful Gentle Godly Hurtful Keen Strong Superior Unpleasant Zealous Odd Rich Epic Fair Fast Heroic
Legendary Spicy Deadly Fine Grand Hasty Neat Papid Unreal Clean Fierce Heavy Light Mythic Pure Smart Titanic Wise
Very Highly Bizarre Itchy Omnious Pleasant Pretty Shiny Simple Strange Vivid Ominous Sharp Rapid Necrotic Fabled
Precise Giant warped_on_aote aoteStone aote_stone Spiritual Treacherous RENOWED Renowned Reinforced rich_bow Spiked
Perfect Magnetic Loving Gilded odd_sword Salty Silky Refined suspicious toil empowered fruitful blessed shaded
awkward dirty undead cubic bloody moil ridiculous rich_sword warped odd_bow candied submerged ancient withered
sweet fleet stellar mithraic Auspicious headstrong stiff bulky lucky bountiful heated jaded ambered double_bit
excellent fortunate prospector lush sturdy lumberjack unyielding great robust rugged zooming peasant strengthened
glistening waxed fortified green_thumb pitchin coldfusion bustling earthy mossy blooming rooted festive snowy
Unknown Any chomp full_jaw_fanging_kit presumed_gallon_of_red_paint displaced_leech Fang_tastic_chocolate_chip
bubba_blister fanged blood_soaked stained menacing hefty soft honored blended astute colossal brilliant
greater_spook beady buzzing jerry_stone hyper coldfused Earthly glacial lustrous blazing scraped royal dimensional
squeaky trashy calcified groovy moonglade bloodshot blood_shot erudite lunar sunny mantid deep_fried overpriced
geometric thorny sticky majestic
""".split()

# The reforges that move the price.
RELEVANT_REFORGES = """
Gilded withered Spiritual jaded warped aote_stone toil Fabled Giant submerged Renowned mossy rooted festive lustrous
glacial coldfused moonglade erudite deep_fried overpriced geometric blood_shot thorny
""".split()

# Reforge, its stone and the cost of applying it at LEGENDARY.
REFORGE_COSTS = [
    (line.split()[0], line.split()[1], int(line.split()[2]))
    for line in """
ambered AMBER_MATERIAL 300000
blessed BLESSED_FRUIT 10000
bulky BULKY_STONE 300000
waxed BLAZE_WAX 150000
candied CANDY_CORN 300000
submerged DEEP_SEA_ORB 750000
fleet DIAMONITE 250000
dirty DIRT_BOTTLE 50000
Fabled DRAGON_CLAW 1000000
Renowned DRAGON_HORN 1000000
Spiked DRAGON_SCALE 600000
Perfect DIAMOND_ATOM 600000
coldfusion ENTROPY_SUPPRESSOR 1000000
Giant GIANT_TOOTH 1000000
bountiful GOLDEN_BALL 300000
stiff HARDENED_WOOD 75000
heated HOT_STUFF 300000
jaded JADERALD 300000
Magnetic LAPIS_CRYSTAL 5000
Silky LUXURIOUS_SPOOL 5000
lucky LUCKY_DICE 300000
Gilded MIDAS_JEWEL 5000000
fortified METEOR_SHARD 150000
moil MOIL_LOG 50000
cubic MOLTEN_CUBE 75000
Necrotic NECROMANCER_BROOCH 300000
fruitful ONYX 2500
Precise OPTICAL_LENS 600000
stellar PETRIFIED_STARFALL 400000
ancient PRECURSOR_GEAR 50000
undead PREMIUM_FLESH 150000
mithraic PURE_MITHRIL 250000
pitchin PITCHIN_KOI 120000
Reinforced RARE_DIAMOND 50000
ridiculous RED_NOSE 150000
Loving RED_SCARF 600000
Refined REFINED_AMBER 10000
Auspicious ROCK_GEMSTONE 300000
empowered SADAN_BROOCH 1000000
Spiritual SPIRIT_DECOY 1000000
suspicious SUSPICIOUS_VIAL 1000000
strengthened SEARING_STONE 150000
glistening SHINY_PRISM 150000
toil TOIL_LOG 10000
aote_stone AOTE_STONE 5000000
withered WITHER_BLOOD 50000
headstrong SALMON_OPAL 250000
mossy OVERGROWN_GRASS 300000
rooted BURROWING_SPORES 300000
festive FROZEN_BAUBLE 400000
snowy TERRY_SNOWGLOBE 200000
chomp KUUDRA_MANDIBLE 300000
fanged FULL_JAW_FANGING_KIT 100000
blood_soaked PRESUMED_GALLON_OF_RED_PAINT 150000
Fang_tastic_chocolate_chip CHOCOLATE_CHIP 0
bubba_blister BUBBA_BLISTER 0
blood_shot SHRIVELED_CORNEA 1000000
""".strip().splitlines()
]

# Where a rarity upgrade matters.
RECOMB_CATEGORIES = ["WEAPON", "ARMOR", "ACCESSORIES", "UNKNOWN"]
RECOMB_TAG_PARTS = """
CLOAK NECKLACE BELT GLOVES BRACELET HOE PICKAXE GAUNTLET WAND ROD DRILL INFINI_VACUUM POWER_ORB
GRIFFIN_UPGRADE_STONE_EPIC
""".split()

# Cost of taking an item off a pet, by tier.
PET_ITEM_REMOVAL = {
    "COMMON": 25_000, "UNCOMMON": 50_000, "RARE": 100_000, "EPIC": 250_000, "LEGENDARY": 500_000,
    "MYTHIC": 1_000_000, "DIVINE": 2_500_000,
}

# Items a set needs beside those that name it.
EXTRA_SET_ITEMS = [
    ("CRIMSON_HUNTER", "BLAZE_BELT"),
    ("SNOW_SUIT", "SNOW_NECKLACE"),
    ("SNOW_SUIT", "SNOW_CLOAK"),
    ("SNOW_SUIT", "SNOW_BELT"),
    ("SNOW_SUIT", "SNOW_GLOVES"),
]

# Master stars; each is needed to go beyond the tier before it.
MASTER_STARS = [
    (6, "FIRST_MASTER_STAR"), (7, "SECOND_MASTER_STAR"), (8, "THIRD_MASTER_STAR"), (9, "FOURTH_MASTER_STAR"),
    (10, "FIFTH_MASTER_STAR"),
]

# Names that are never shown as a search result's name.
HIDDEN_NAMES = ["Beastmaster Crest", "Griffin Upgrade Stone"]

# Shards whose tag is not just the upper-case name.
SHARD_TAG_EXCEPTIONS = {
    "Inferno Demonlord": "BURNINGSOUL",
    "Bogged": "SEA_ARCHER",
    "Cinderbat": "CINDER_BAT",
    "End Stone Protector": "ENDSTONE_PROTECTOR",
    "Loch Emperor": "SEA_EMPEROR",
    "Abyssal Lanternfish": "ABYSSAL_LANTERN",
    "Lotusfish": "LOTUS_FISH",
    "Inkling": "NIGHT_SQUID",
    "Flipflopper": "FLIP_FLOPPER",
    "Seashine": "SEA_SHINE",
    "Beetle": "CROPEETLE",
    "Earthworm": "TERMITE",
    "Field Mouse": "PEST",
    "Stridersurfer": "STRIDER_SURFER",
    "Wither Spectre": "WITHER_SPECTER",
    "Zealot Bruiser": "BRUISER",
}
