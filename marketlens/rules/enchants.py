"""Enchantment rules. All tables below are fixed values of the market's rules."""

from __future__ import annotations


def pairs(text: str) -> dict[str, int]:
    words = text.split()
    return {name: int(level) for name, level in zip(words[::2], words[1::2])}


# From which level an enchantment counts as relevant.
# Every ultimate_* type that is not listed counts from level 1.
RELEVANT_LEVELS = pairs("""
first_strike 5 triple_strike 5 life_steal 5 looting 5 scavenger 5 syphon 5 vicious 1 chance 5 snipe 4 pristine 1
overload 2 smite 7 critical 7 giant_killer 7 luck 7 angler 7 spiked_hook 7 caster 7 magnet 7 luck_of_the_sea 7
thunderlord 7 lethality 7 thunderbolt 8 infinite_quiver 11 feather_falling 11 ultimate_last_stand 3
ultimate_bank 6 ultimate_jerry 6 ultimate_no_pain_no_gain 5 ultimate_rend 3 ultimate_swarm 3 ultimate_wise 4
ultimate_wisdom 3 compact 1 counter_strike 5 experience 5 smarty_pants 2 cultivating 1 smoldering 1 strong_mana 5
hardened_mana 5 mana_vampire 4 ferocious_mana 2 charm 4 big_brain 3 cayenne 5 divine_gift 1 green_thumb 1
prosperity 1 dedication 1 tabasco 3 fire_aspect 3 power 7 pesterminator 1 ultimate_refrigerate 1 ultimate_the_one 4
reflection 5 expertise 1 paleontologist 1 ice_cold 1 toxophilite 1 lapidary 2 ultimate_habanero_tactics 4
replenish 1 quick_bite 1 absorb 1 forest_pledge 4 raspiration 4 scuba 3 sugar_rush 3 delicate 5 quantum 5
rejuvenate 5 transylvanian 5 true_protection 1 turbo_potato 5 turbo_cactus 5 turbo_coco 5 turbo_pumpkin 5
small_brain 5
""")

# Enchantments worth 20 million or more, with the level from which they are.
VERY_VALUABLE_LEVELS = pairs("""
execute 6 ultimate_legion 5 big_brain 4 cayenne 5 chance 5 counter_strike 5 turbo_cactus 5 ender_slayer 7
sharpness 7 strong_mana 8 hardened_mana 9 mana_vampire 9 prosecute 6 growth 7 ultimate_chimera 1 smoldering 5
critical 7 ultimate_reiterate 2 venomous 6 ferocious_mana 6 power 7 ultimate_bobbin_time 3 first_strike 5
ultimate_flash 5 ultimate_fatal_tempo 1 snipe 4 vicious 5 giant_killer 7 triple_strike 5 ultimate_inferno 1
syphon 5 looting 5 cubism 6 luck 7 titan_killer 7 efficiency 8 divine_gift 1 green_thumb 3 prosperity 4
dedication 4 pesterminator 4 ultimate_the_one 4 experience 5
""")

# Highest level an enchanting table can give.
TABLE_LEVELS = pairs("""
sharpness 5 smite 5 bane_of_arthropods 5 looting 3 cubism 5 cleave 5 life_steal 3 giant_killer 5 critical 5
first_strike 4 triple_strike 4 ender_slayer 5 execute 5 thunderlord 5 lethality 5 syphon 3 vampirism 5 venomous 5
thunderbolt 5 prosecute 5 titan_killer 5 luck 5 protection 5 blast_protection 5 projectile_protection 5
fire_protection 5 thorns 3 growth 5 frost_walker 2 feather_falling 5 depth_strider 3 aqua_affinity 1 respiration 3
silk_touch 1 smelting_touch 1 fortune 3 experience 3 efficiency 5 harvesting 5 piscary 5
""")

# Keys that are attributes, not enchantments.
ATTRIBUTE_KEYS = """
lifeline breeze speed experience mana_pool life_regeneration blazing_resistance arachno_resistance
undead_resistance blazing_fortune fishing_experience double_hook infection trophy_hunter fisherman hunter
fishing_speed life_recovery ignition combo attack_speed midas_touch mana_regeneration veteran mending
ender_resistance dominance ender mana_steal blazing elite arachno undead warrior deadeye fortitude magic_find
""".split()

# Enchantments that grow with an attribute (attribute, coins per unit, most units that count).
GROWTH = {
    "cultivating": ("farmed_cultivating", 0.13, 100_000_000),
    "champion": ("champion_combat_xp", 1.0, 3_000_000),
    "toxophilite": ("toxophilite_combat_xp", 1.0, 3_000_000),
    "compact": ("compact_blocks", 6.0, 1_000_000),
    "hecatomb": ("hecatomb_s_runs", 200_000.0, 100),
    "absorb": ("absorb_logs_chopped", 0.1, 50_000_000),
    "expertise": ("expertise_kills", 1000.0, 15_000),
}

# Current display name to internal name.
RENAMED = {
    "pyroclasm": "magmarizer",
    "Drain": "syphon",
    "Woodsplitter": "arcane",
    "Gravity": "dragon_hunter",
    "Dragon_Tracer": "aiming",
    "Prismatic": "pristine",
    "Duplex": "ultimate_reiterate",
    "Bobbin'_Time": "ultimate_bobbin_time",
    "Strong_Vitality": "strong_mana",
    "Hardened_Vitality": "hardened_mana",
    "Vivacious_Vitality": "ferocious_mana",
    "Vampiric_Vitality": "mana_vampire",
    "Turbo_Cocoa": "TURBO_COCO",
    "Turbo_Cacti": "TURBO_CACTUS",
}

# Enchantments that do not matter on an item, as (type, level, tags).
IRRELEVANT_ON = [
    ("ultimate_wise", 10, """
        AMETHYST_GAUNTLET DEMONLORD_GAUNTLET ENDER_GAUNTLET GAUNTLET_OF_CONTAGION GEMSTONE_GAUNTLET
        GLOWSTONE_GAUNTLET MAGMA_LORD_GAUNTLET MITHRIL_GAUNTLET TITANIUM_GAUNTLET VANQUISHED_GLOWSTONE_GAUNTLET
        AMBER_POLISHED_DRILL_ENGINE DIVAN_DRILL DRILL_ENGINE GEMSTONE_DRILL_1 GEMSTONE_DRILL_2 GEMSTONE_DRILL_3
        GEMSTONE_DRILL_4 MITHRIL_DRILL_1 MITHRIL_DRILL_2 MITHRIL_DRILL_ENGINE RUBY_POLISHED_DRILL_ENGINE
        SAPPHIRE_POLISHED_DRILL_ENGINE TITANIUM_DRILL_1 TITANIUM_DRILL_2 TITANIUM_DRILL_3 TITANIUM_DRILL_4
        TITANIUM_DRILL_ENGINE""".split()),
    ("ultimate_legion", 10, """
        DIVAN_ALLOY DIVAN_BOOTS DIVAN_CHESTPLATE DIVAN_DRILL DIVAN_FRAGMENT DIVAN_HELMET DIVAN_LEGGINGS
        DIVAN_PENDANT DIVAN_POWDER_COATING""".split()),
    ("ultimate_wisdom", 10, """
        DIVAN_ALLOY DIVAN_BOOTS DIVAN_CHESTPLATE DIVAN_DRILL DIVAN_FRAGMENT DIVAN_HELMET DIVAN_LEGGINGS
        DIVAN_PENDANT DIVAN_POWDER_COATING""".split()),
    ("efficiency", 6, ["STONK_PICKAXE"]),
    ("efficiency", 10, ["PROMISING_AXE", "PROMISING_HOE", "PROMISING_PICKAXE", "PROMISING_SPADE"]),
]
# This one does not matter anywhere but on these tags.
RELEVANT_ONLY_ON = ("ender_slayer", 6, ["ATOMSPLIT_KATANA", "VOIDEDGE_KATANA", "VOIDWALKER_KATANA", "VORPAL_KATANA"])
