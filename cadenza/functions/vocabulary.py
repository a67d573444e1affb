"""The controlled vocabulary of semantic profiles."""

from __future__ import annotations

# Labels, word lists and weights that results must agree with.
KEYS = ("top_keywords", "affect", "energy", "valence", "genre_style", "narrative_theme", "listening_context", "cohesion", "next_song_role")
LIST_KEYS = ("top_keywords", "affect", "genre_style", "narrative_theme")
ALLOWED = {
    "top_keywords": ["high_arousal", "low_arousal", "dancefloor", "theatrical", "rebellious", "melancholic_story", "nostalgic", "cinematic", "angsty", "romantic_tension", "party", "workout", "roadtrip", "chill", "singalong", "dark", "uplifting", "confident", "dreamy", "aggressive", "playful", "anime", "club", "acoustic", "heartbreak", "empowerment", "mixed"],
    "affect": ["confident", "dramatic", "melancholic", "angsty", "euphoric", "dark", "playful", "dreamy", "aggressive", "nostalgic", "romantic", "chill", "uplifting", "mixed"],
    "genre_style": ["rock", "alt_rock", "classic_rock", "pop", "dance_pop", "hiphop", "rnb", "country", "soul", "folk", "metal", "electronic", "electropop", "punk", "indie", "soundtrack", "anime", "mixed"],
    "narrative_theme": ["love", "heartbreak", "desire", "self_expression", "youth", "escape", "loneliness", "resilience", "celebration", "conflict", "fantasy", "coming_of_age", "depression", "empowerment", "mixed"],
    "listening_context": ["party", "wedding", "halloween", "workout", "roadtrip", "chill", "slow_dance", "nostalgia", "singalong", "background", "mixed"],
    "energy": ["low", "mid", "high"],
    "valence": ["negative", "mixed", "positive"],
    "cohesion": ["genre", "affect", "activity", "theme", "story", "mixed"],
    "next_song_role": ["same_vibe", "energy_lift", "cooldown", "genre_bridge", "singalong", "romantic", "spooky"],
}
FALLBACK_KEYWORDS = ["mixed", "high_arousal", "nostalgic"]
FALLBACKS = {"energy": "mid", "next_song_role": "same_vibe"}
EXPANSIONS = {
    "high_arousal": ["dance", "fire", "wild", "tonight", "loud", "run", "fight", "party"],
    "low_arousal": ["slow", "soft", "quiet", "sleep", "dream", "rain", "alone"],
    "dancefloor": ["dance", "club", "floor", "dj", "beat", "body", "tonight"],
    "theatrical": ["drama", "fame", "show", "stage", "monster", "applause", "glory"],
    "rebellious": ["fight", "break", "riot", "rebel", "wild", "control", "rules"],
    "melancholic_story": ["sad", "cry", "tears", "lonely", "goodbye", "miss", "broken", "pain"],
    "nostalgic": ["remember", "yesterday", "old", "again", "home", "memory", "time"],
    "cinematic": ["dream", "sky", "world", "story", "night", "light", "hero"],
    "angsty": ["pain", "hate", "alone", "broken", "scream", "dark", "inside"],
    "romantic_tension": ["love", "heart", "kiss", "touch", "desire", "need", "want"],
    "party": ["party", "tonight", "dance", "drink", "club", "everybody"],
    "workout": ["run", "strong", "fight", "power", "move", "body"],
    "roadtrip": ["road", "drive", "highway", "home", "miles", "ride"],
    "chill": ["slow", "easy", "relax", "quiet", "soft", "dream"],
    "singalong": ["sing", "song", "na", "la", "everybody", "chorus"],
    "dark": ["dark", "black", "night", "shadow", "dead", "fear"],
    "uplifting": ["hope", "rise", "light", "free", "alive", "higher"],
    "confident": ["fame", "money", "power", "boss", "strong", "winner"],
    "dreamy": ["dream", "sleep", "sky", "moon", "stars", "float"],
    "aggressive": ["fight", "kill", "rage", "blood", "scream", "fire"],
    "playful": ["fun", "play", "baby", "smile", "crazy", "sweet"],
    "anime": ["hero", "dream", "world", "story", "fight", "future"],
    "club": ["club", "dance", "dj", "beat", "floor", "bass"],
    "acoustic": ["guitar", "home", "simple", "voice", "song"],
    "heartbreak": ["heart", "broken", "goodbye", "tears", "miss", "alone"],
    "empowerment": ["strong", "free", "power", "rise", "fight", "alive"],
    "depression": ["sad", "alone", "dark", "cry", "pain", "empty", "broken"],
}
GENRE_WORDS = {
    "rock": ["guitar", "rock", "band", "loud"],
    "dance_pop": ["dance", "party", "club", "beat", "body"],
    "electropop": ["electric", "neon", "synth", "fame", "monster"],
    "hiphop": ["rap", "flow", "money", "mic", "street"],
    "rnb": ["baby", "love", "touch", "slow", "body"],
    "country": ["road", "truck", "home", "whiskey", "town"],
    "soundtrack": ["story", "hero", "world", "dream", "sky"],
    "anime": ["hero", "future", "world", "fight", "dream"],
    "metal": ["blood", "rage", "scream", "dark", "fire"],
    "folk": ["home", "river", "simple", "guitar", "old"],
}
AFFECT_WORDS = {
    "confident": ["strong", "power", "winner", "fame", "money"],
    "dramatic": ["drama", "stage", "show", "applause", "glory"],
    "melancholic": ["sad", "tears", "cry", "lonely", "goodbye"],
    "angsty": ["pain", "hate", "broken", "scream", "inside"],
    "euphoric": ["tonight", "party", "alive", "higher", "free"],
    "dark": ["dark", "black", "shadow", "dead", "fear"],
    "playful": ["fun", "play", "baby", "smile", "crazy"],
    "dreamy": ["dream", "moon", "stars", "sleep", "sky"],
    "nostalgic": ["remember", "yesterday", "again", "home", "time"],
    "romantic": ["love", "heart", "kiss", "touch", "desire"],
    "chill": ["slow", "easy", "quiet", "soft", "relax"],
    "uplifting": ["hope", "rise", "light", "free", "alive"],
}
THEME_WORDS = {
    "love": ["love", "heart", "kiss", "baby", "desire"],
    "heartbreak": ["broken", "goodbye", "tears", "miss", "alone"],
    "desire": ["want", "need", "touch", "body", "desire"],
    "self_expression": ["fame", "show", "applause", "born", "free"],
    "youth": ["young", "school", "summer", "teen", "kid"],
    "escape": ["run", "away", "escape", "leave", "road"],
    "loneliness": ["alone", "lonely", "empty", "night", "miss"],
    "resilience": ["rise", "strong", "fight", "survive", "alive"],
    "celebration": ["party", "tonight", "dance", "drink", "everybody"],
    "conflict": ["fight", "war", "hate", "break", "hurt"],
    "fantasy": ["dream", "magic", "world", "monster", "fairy"],
    "coming_of_age": ["young", "grow", "learn", "home", "time"],
    "depression": ["sad", "alone", "dark", "pain", "empty"],
    "empowerment": ["power", "strong", "free", "rise", "fight"],
}
CONTEXT_WORDS = {
    "party": ["party", "club", "dance", "tonight", "drink"],
    "workout": ["run", "strong", "fight", "move", "body"],
    "roadtrip": ["road", "drive", "highway", "ride", "miles"],
    "chill": ["slow", "easy", "quiet", "soft", "dream"],
    "singalong": ["sing", "song", "everybody", "chorus"],
    "nostalgia": ["remember", "old", "again", "home", "time"],
}
SONG_POSITIVE = ["love", "party", "hope", "free", "smile", "alive", "dance"]
SONG_NEGATIVE = ["sad", "cry", "tears", "lonely", "pain", "broken", "dark"]
LIST_POSITIVE = ["love", "happy", "dance", "party", "smile", "hope", "free", "tonight", "dream"]
LIST_NEGATIVE = ["sad", "cry", "miss", "lonely", "alone", "tears", "goodbye", "pain", "broken"]
LIST_HIGH = ["dance", "party", "club", "fire", "run", "jump", "loud", "wild", "fight"]
LIST_LOW = ["sleep", "quiet", "soft", "slow", "rain", "alone", "dream", "night"]
ALIASES = {
    "medium": "mid",
    "moderate": "mid",
    "alt": "alt_rock",
    "alternative": "alt_rock",
    "alternative_rock": "alt_rock",
    "classic": "classic_rock",
    "rap": "hiphop",
    "hip_hop": "hiphop",
    "r_b": "rnb",
    "r_and_b": "rnb",
    "edm": "electronic",
    "00s": "2000s",
    "2000": "2000s",
    "10s": "2010s",
    "2010": "2010s",
    "90": "90s",
    "90s_": "90s",
    "1990s": "90s",
    "80": "80s",
    "1980s": "80s",
    "70": "70s",
    "1970s": "70s",
    "60": "60s",
    "1960s": "60s",
    "positive_upbeat": "positive",
    "upbeat": "happy",
    "energetic": "high",
    "intense": "high_arousal",
    "hype": "high_arousal",
    "excited": "high_arousal",
    "exciting": "high_arousal",
    "pump_up": "high_arousal",
    "calm": "low_arousal",
    "soft": "low_arousal",
    "clubby": "dancefloor",
    "club_music": "dancefloor",
    "dance": "dancefloor",
    "dance_pop": "dance_pop",
    "dramatic": "theatrical",
    "drama": "theatrical",
    "melancholy": "melancholic",
    "sad": "melancholic",
    "sadness": "melancholic",
    "depressed": "depression",
    "depressive": "depression",
    "anime_opening": "anime",
    "anime_ost": "anime",
    "ost": "soundtrack",
    "film_score": "cinematic",
    "movie": "cinematic",
    "empowering": "empowerment",
    "self_expression": "self_expression",
    "heart_break": "heartbreak",
    "heartbroken": "heartbreak",
    "angst": "angsty",
    "same_mood": "same_vibe",
    "bridge": "genre_bridge",
    "thematic": "theme",
    "theme_based": "theme",
    "genre_based": "genre",
    "mood_based": "affect",
    "activity_based": "activity",
    "vibe": "affect",
}
OVERLAP_WEIGHTS = {"top_keywords": 4.0, "affect": 2.0, "genre_style": 2.0, "narrative_theme": 2.0}
EXACT_WEIGHTS = {"energy": 1.0, "valence": 0.75, "listening_context": 1.0}
CROSS = {
    "romantic_tension": ["romantic", "love", "desire"],
    "heartbreak": ["heartbreak", "melancholic", "loneliness", "depression"],
    "melancholic_story": ["melancholic", "heartbreak", "loneliness", "depression"],
    "theatrical": ["dramatic", "self_expression"],
    "confident": ["confident", "empowerment"],
    "dancefloor": ["euphoric", "celebration"],
    "party": ["euphoric", "celebration"],
    "dark": ["dark", "conflict", "depression"],
    "angsty": ["angsty", "conflict"],
    "uplifting": ["uplifting", "resilience", "empowerment"],
}
VECTOR_WEIGHTS = {"top_keywords": 1.6, "affect": 2.2, "genre_style": 1.2, "narrative_theme": 1.7, "energy": 1.0, "valence": 0.8, "listening_context": 0.8}
