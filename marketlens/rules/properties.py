"""Which items an attribute of an item stands for. Fixed values of the market's rules."""

from __future__ import annotations

# Attribute keys whose value is an item tag.
ITEM_KEYS = (
    ["heldItem"]
    + [f"personal_compact_{i}" for i in range(12)]
    + [f"personal_compactor_{i}" for i in range(7)]
    + [f"personal_deletor_{i}" for i in range(10)]
    + """last_potion_ingredient power_ability_scroll skin dye_item drill_part_engine drill_part_fuel_tank
    drill_part_upgrade_module engine.id fuel_tank.id upgrade_module.id hook.part line.part sinker.part""".split()
)

# Attribute keys whose text value gets a dictionary id.
TEXT_KEYS = """
effect cake_owner dungeon_skill_req backpack_color potion potion_type party_hat_color initiator_player
drill_part_engine drill_part_fuel_tank drill_part_upgrade_module captured_player potion_name dungeon_paper_id
leaderboard_player event mob_id entity_required talisman_enrichment repelling_color fungi_cutter_mode
builder's_wand_data jumbo_backpack_data greater_backpack_data medium_backpack_data large_backpack_data
small_backpack_data spray new_year_cake_bag_data ability_scroll mixins UNIVERSAL_0 UNIVERSAL_0_gem JADE_0 JADE_1
JADE_2 TOPAZ_0 AMBER_0 AMBER_1 AMBER_2 RUBY_0 AMETHYST_0 AMETHYST_1 AMETHYST_2 SAPPHIRE_0 JASPER_0 RUBY_1 RUBY_2
RUBY_3 RUBY_4 COMBAT_0 COMBAT_0_gem COMBAT_1 COMBAT_1_gem DEFENSIVE_0 DEFENSIVE_0_gem MINING_0 MINING_0_gem
unlocked_slots hideRightClick
""".split()

# Attribute keys that are not indexed.
IGNORED_KEYS = ["uniqueId", "noMove", "petSoulbound"]

# Attribute keys holding a hexadecimal id.
ID_KEYS = ["uid", "uuid", "heldItemUuid", "spawnedFor", "bossId"]

# Attributes that enter the training features.
FEATURE_KEYS = """
color dungeon_item_level rarity_upgrades hpc exp candyUsed potion_level potion_type splash level effect
duration_ticks blood_god_kills dungeon_skill_req baseStatBoostPercentage item_durability item_tier expertise_kills
winning_bid new_years_cake zombie_kills skin entity_required compact_blocks ZOMBIE_SLAYER talisman_enrichment
bow_kills spider_kills raider_kills backpack_color wood_singularity_count ultimateSoulEaterData sword_kills enhanced
extended ranchers_speed repelling_color event drill_part_fuel_tank ammo dungeon_paper_id drill_part_upgrade_module
ability_scroll art_of_war_count mob_id farming_for_dummies_count bottle_of_jyrre_seconds leaderVotes leaderPosition
captured_player captured_date initiator_player party_hat_year party_hat_color caffeinated fishes_caught
trainingWeightsHeldTime fungi_cutter_mode magmaCubesKilled blocksBroken radius maxed_stats drill_part_engine
dungeon_potion trapsDefused skeletorKills should_give_alchemy_exp farmed_cultivating health mixins
tuning_fork_tuning zombiesKilled tear_filled slayer_energy
""".split()

# Fixed values: (key, value) -> (items needed, level below it).
EXACT_RULES = {
    ("upgrade_level", "10"): (["FIFTH_MASTER_STAR"], "9"),
    ("upgrade_level", "9"): (["FOURTH_MASTER_STAR"], "8"),
    ("upgrade_level", "8"): (["THIRD_MASTER_STAR"], "7"),
    ("upgrade_level", "7"): (["SECOND_MASTER_STAR"], "6"),
    ("upgrade_level", "6"): (["FIRST_MASTER_STAR"], ""),
    ("rarity_upgrades", "1"): (["RECOMBOBULATOR_3000"], ""),
    ("ethermerge", "1"): (["ETHERWARP_CONDUIT", "ETHERWARP_MERGER"], ""),
    ("artOfPeaceApplied", "1"): (["THE_ART_OF_PEACE"], ""),
    ("art_of_war_count", "1"): (["THE_ART_OF_WAR"], ""),
    ("divan_powder_coating", "1"): (["DIVAN_POWDER_COATING"], ""),
    ("wood_singularity_count", "1"): (["WOOD_SINGULARITY"], ""),
    ("jalapeno_count", "1"): (["JALAPENO_BOOK"], ""),
    ("hpc", "15"): (["FUMING_POTATO_BOOK"], "14"),
    ("hpc", "14"): (["FUMING_POTATO_BOOK"], "13"),
    ("hpc", "13"): (["FUMING_POTATO_BOOK"], "12"),
    ("hpc", "12"): (["FUMING_POTATO_BOOK"], "11"),
    ("hpc", "11"): (["FUMING_POTATO_BOOK"], "10"),
    ("hotpc", "1"): (["FUMING_POTATO_BOOK"] * 4, "0.1"),
    ("hotpc", "0.1"): (["FUMING_POTATO_BOOK"], "0"),
    ("hotpc", "0"): (["HOT_POTATO_BOOK"] * 10, ""),
}

# Key -> (item needed, whether the value counts how many).
WILDCARD_RULES = {
    "stats_book": ("BOOK_OF_STATS", False),
    "tuned_transmission": ("TRANSMISSION_TUNER", True),
    "mana_disintegrator_count": ("MANA_DISINTEGRATOR", True),
    "polarvoid": ("POLARVOID_BOOK", True),
    "bookworm_books": ("BOOKWORM_BOOK", True),
    "hpc": ("HOT_POTATO_BOOK", True),
    "farming_for_dummies_count": ("FARMING_FOR_DUMMIES", True),
}

# Armour families whose stars are not master stars.
STAR_FAMILIES = ["CRIMSON", "TERROR", "AURORA", "FERVOR", "HOLLOW"]

# Runes that take one base rune at every level.
SINGLE_RUNES = """
RUNE_GOLDEN_CARPET RUNE_BARK_TUNES RUNE_MEOW_MUSIC RUNE_PRIMAL_FEAR RUNE_GRAND_FREEZING RUNE_SPELLBOUND
RUNE_GRAND_SEARING
""".split()

# Gem qualities that are priced, and slot names that do not name the gem.
GEM_QUALITIES = ["PERFECT", "FLAWLESS", "ROUGH", "FINE"]
GENERIC_SLOTS = ["UNIVERSAL", "COMBAT", "DEFENSIVE", "MINING", "OFFENSIVE", "CHISEL"]
