"""Words and patterns of the rules on mods."""

# Token, and the words of which all (or one of the alternatives) stand in a mod.
MOD_TOKENS = (
    ("SpellDamage", (("spell", "damage"),)),
    ("CastSpeed", (("cast speed",), ("casting speed",))),
    ("CritChanceSpells", (("critical", "spell"),)),
    ("Life", (("maximum life",), (" life",))),
    ("SpellSuppress", (("suppress",),)),
    ("Resist", (("resist",),)),
    ("ClusterPassive", (("cluster",),)),
    ("Mana", (("mana",),)),
    ("Attributes", (("attributes",), ("strength",), ("dexterity",), ("intelligence",))),
    ("Chaos", (("chaos",),)),
)
# Tags by words of a mod.
MOD_TAGS = (("spell", ("spell",)), ("attack", ("attack",)), ("life", ("life",)), ("resistance", ("resist",)), ("suppression", ("suppress",)), ("crit", ("crit",)))
# The sentence of a mod whose number is a gem level, and what counts as a number; they decide what features are.
GEM_LEVEL = r"(?i)\+(\d+)\s+to\s+level\s+of\s+all\s+.+?skill\s+gems"
NUMBER = r"[-+]?\d+(?:\.\d+)?"
