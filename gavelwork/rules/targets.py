"""The static watch list: sealed products and single cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- Fixed values: watched sealed products (name, set, kind) -------------------------------
SEALED = (
    ("Sword & Shield Booster Box", "Sword & Shield", "Booster Box"),
    ("Sword & Shield Elite Trainer Box", "Sword & Shield", "Elite Trainer Box"),
    ("Rebel Clash Booster Box", "Rebel Clash", "Booster Box"),
    ("Rebel Clash Elite Trainer Box", "Rebel Clash", "Elite Trainer Box"),
    ("Darkness Ablaze Booster Box", "Darkness Ablaze", "Booster Box"),
    ("Darkness Ablaze Elite Trainer Box", "Darkness Ablaze", "Elite Trainer Box"),
    ("Vivid Voltage Booster Box", "Vivid Voltage", "Booster Box"),
    ("Vivid Voltage Elite Trainer Box", "Vivid Voltage", "Elite Trainer Box"),
    ("Battle Styles Booster Box", "Battle Styles", "Booster Box"),
    ("Battle Styles Elite Trainer Box", "Battle Styles", "Elite Trainer Box"),
    ("Chilling Reign Booster Box", "Chilling Reign", "Booster Box"),
    ("Chilling Reign Elite Trainer Box", "Chilling Reign", "Elite Trainer Box"),
    ("Evolving Skies Booster Box", "Evolving Skies", "Booster Box"),
    ("Evolving Skies Elite Trainer Box", "Evolving Skies", "Elite Trainer Box"),
    ("Fusion Strike Booster Box", "Fusion Strike", "Booster Box"),
    ("Fusion Strike Elite Trainer Box", "Fusion Strike", "Elite Trainer Box"),
    ("Brilliant Stars Booster Box", "Brilliant Stars", "Booster Box"),
    ("Brilliant Stars Elite Trainer Box", "Brilliant Stars", "Elite Trainer Box"),
    ("Astral Radiance Booster Box", "Astral Radiance", "Booster Box"),
    ("Astral Radiance Elite Trainer Box", "Astral Radiance", "Elite Trainer Box"),
    ("Pokemon GO Elite Trainer Box", "Pokemon GO", "Elite Trainer Box"),
    ("Lost Origin Booster Box", "Lost Origin", "Booster Box"),
    ("Lost Origin Elite Trainer Box", "Lost Origin", "Elite Trainer Box"),
    ("Silver Tempest Booster Box", "Silver Tempest", "Booster Box"),
    ("Silver Tempest Elite Trainer Box", "Silver Tempest", "Elite Trainer Box"),
    ("Scarlet & Violet Booster Box", "Scarlet & Violet", "Booster Box"),
    ("Scarlet & Violet Elite Trainer Box", "Scarlet & Violet", "Elite Trainer Box"),
    ("Paldea Evolved Booster Box", "Paldea Evolved", "Booster Box"),
    ("Paldea Evolved Elite Trainer Box", "Paldea Evolved", "Elite Trainer Box"),
    ("Obsidian Flames Booster Box", "Obsidian Flames", "Booster Box"),
    ("Obsidian Flames Elite Trainer Box", "Obsidian Flames", "Elite Trainer Box"),
    ("151 Elite Trainer Box", "151", "Elite Trainer Box"),
    ("151 Ultra Premium Collection", "151", "Ultra Premium Collection"),
    ("Paradox Rift Booster Box", "Paradox Rift", "Booster Box"),
    ("Paradox Rift Elite Trainer Box", "Paradox Rift", "Elite Trainer Box"),
    ("Paldean Fates Elite Trainer Box", "Paldean Fates", "Elite Trainer Box"),
    ("Temporal Forces Booster Box", "Temporal Forces", "Booster Box"),
    ("Temporal Forces Elite Trainer Box", "Temporal Forces", "Elite Trainer Box"),
    ("Twilight Masquerade Booster Box", "Twilight Masquerade", "Booster Box"),
    ("Twilight Masquerade Elite Trainer Box", "Twilight Masquerade", "Elite Trainer Box"),
    ("Shrouded Fable Elite Trainer Box", "Shrouded Fable", "Elite Trainer Box"),
    ("Stellar Crown Booster Box", "Stellar Crown", "Booster Box"),
    ("Stellar Crown Elite Trainer Box", "Stellar Crown", "Elite Trainer Box"),
    ("Surging Sparks Booster Box", "Surging Sparks", "Booster Box"),
    ("Surging Sparks Elite Trainer Box", "Surging Sparks", "Elite Trainer Box"),
)

# --- Fixed values: watched cards (name, set, number, category) -----------------------------
CARDS = (
    ("Charizard V", "Brilliant Stars", "154", "charizard_premium"),
    ("Charizard VSTAR", "Brilliant Stars", "18", "charizard_premium"),
    ("Charizard", "Base Set", "4", "vintage_icon"),
    ("Charizard ex", "151", "6", "151_premium"),
    ("Charizard ex", "Obsidian Flames", "125", "sv_premium"),
    ("Pikachu VMAX", "Vivid Voltage", "188", "pikachu_premium"),
    ("Pikachu", "Base Set", "25", "vintage_icon"),
    ("Pikachu V", "Vivid Voltage", "43", "pikachu_premium"),
    ("Pikachu", "151", "25", "151_growth"),
    ("Umbreon V", "Evolving Skies", "189", "eeveelution_premium"),
    ("Espeon V", "Evolving Skies", "64", "eeveelution_premium"),
    ("Leafeon V", "Evolving Skies", "7", "eeveelution_premium"),
    ("Glaceon V", "Evolving Skies", "40", "eeveelution_premium"),
    ("Sylveon V", "Evolving Skies", "74", "eeveelution_premium"),
    ("Eevee", "151", "133", "151_growth"),
    ("Rayquaza V", "Evolving Skies", "110", "legendary_premium"),
    ("Rayquaza VMAX", "Evolving Skies", "111", "legendary_premium"),
    ("Lugia V", "Silver Tempest", "138", "current_meta"),
    ("Lugia VSTAR", "Silver Tempest", "139", "current_meta"),
    ("Mewtwo ex", "151", "150", "151_premium"),
    ("Mew ex", "151", "151", "151_premium"),
    ("Blastoise", "Base Set", "2", "vintage_icon"),
    ("Venusaur", "Base Set", "15", "vintage_icon"),
    ("Alakazam", "Base Set", "1", "vintage_rare"),
    ("Machamp", "Base Set", "8", "vintage_rare"),
    ("Gyarados", "Base Set", "6", "vintage_rare"),
    ("Mew V", "Fusion Strike", "113", "modern_alt_art"),
    ("Giratina V", "Lost Origin", "130", "modern_legendary"),
    ("Giratina VSTAR", "Lost Origin", "131", "modern_legendary"),
    ("Arceus V", "Brilliant Stars", "122", "competitive_meta"),
    ("Arceus VSTAR", "Brilliant Stars", "123", "competitive_meta"),
    ("Charmander", "151", "4", "151_growth"),
    ("Squirtle", "151", "7", "151_growth"),
    ("Bulbasaur", "151", "1", "151_growth"),
    ("Snorlax", "151", "143", "151_growth"),
    ("Miraidon ex", "Scarlet & Violet", "81", "sv_legendary"),
    ("Koraidon ex", "Scarlet & Violet", "54", "sv_legendary"),
    ("Iron Valiant ex", "Paradox Rift", "89", "paradox_pokemon"),
    ("Roaring Moon ex", "Paradox Rift", "124", "paradox_pokemon"),
    ("Mewtwo V", "Pokemon GO", "30", "modern_premium"),
    ("Dragonite V", "Pokemon GO", "131", "modern_alt_art"),
    ("Radiant Charizard", "Pokemon GO", "11", "radiant_premium"),
    ("Radiant Venusaur", "Pokemon GO", "4", "radiant_premium"),
    ("Lugia", "Neo Genesis", "9", "neo_classic"),
    ("Ho-Oh", "Neo Revelation", "7", "neo_classic"),
    ("Dragonite", "Fossil", "4", "vintage_rare"),
    ("Professor Oak", "Base Set", "88", "vintage_trainer"),
    ("Rayquaza", "Skyridge", "149", "vintage_rare"),
    ("Charizard", "Base Set 2", "4", "vintage_icon"),
    ("Charizard V", "Champion's Path", "20", "charizard_premium"),
)


def sealed_targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(SEALED), "product_name string, set_name string, product_type string"
    )


def card_targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(CARDS), "card_name string, set_name string, card_number string, category string"
    )


def target_categories(spark: SparkSession) -> DataFrame:
    """Number of watched cards per category, largest first."""
    from pyspark.sql import functions as F

    return (
        card_targets(spark).groupBy("category").agg(F.count("*").alias("cards"))
        .orderBy(F.desc("cards"), "category")
    )
