"""Word lists, thresholds and tables that results depend on, in one place."""

from __future__ import annotations

# They must equal those of the behaviour that this engine matches.

STOPWORDS = "a an and are as at be by do does for from how in is it of on or that the their this to use what with".split()

SPEECH_TERMS = "say said says speak speaks speaker talk talks tell tells mention mentions voice transcript ask asks asked admit admits admitted narrator narrates narration commentary broadcast discusses states".split()
CONCEPTUAL_TERMS = "according answer claim claims explain explains idea mean means reason why".split()
VISUAL_TERMS = "appear appears display displayed image logo projection show showing shows see seen look looks wearing holding hand visible object person people text screen slide title frame".split()
TEMPORAL_TERMS = "after before then next prior following during when while".split()
GLOBAL_TERMS = "summarize summary overall main theme about describe overview".split()
SOUND_TERMS = "sound noise music applause alarm siren laugh laughing engine bang gunshot footsteps".split()
COUNTING_TERMS = "count counting many number largest smallest more most least total".split()
NEGATIVE_TERMS = "not except neither none without didn doesn isn aren absent missing undiscussed".split()
NEGATIVE_PHRASES = ["not discussed", "not mentioned", "does not", "did not", "is not", "are not", "which of the following is not"]
SCREEN_TEXT_PHRASES = ["on-screen text", "onscreen text", "screen text", "slide says", "text says", "title says"]
OPENING_MARKERS = ["opening", "beginning", " start", "first"]
INTENT_REASONS = {
    "blank": "blank or tokenless query defaults to mixed audio-visual routing",
    "negative": "negative query terms require coverage of mentioned and unmentioned alternatives",
    "counting": "counting/comparison terms require denser visual evidence around relevant moments",
    "global_only": "global summary terms favor broad segment coverage",
    "screen_text": "on-screen text query favors OCR/frame retrieval over transcript retrieval",
    "speech_visual": "speech and visual terms require cross-modal evidence",
    "temporal": "temporal markers require continuity around relevant moments",
    "conceptual": "conceptual question terms favor transcript-first retrieval",
    "speech": "speech terms favor transcript-first retrieval",
    "sound": "sound-event terms favor audio event retrieval",
    "visual": "visual terms favor frame and object/action retrieval",
    "global": "global terms favor broad segment coverage",
    "none": "no dominant route detected; using mixed audio-visual retrieval",
}

ASPECT_VISUAL_TERMS = "see show shirt person frame object scene screen visible slide text title look appears gesture".split()
ASPECT_AUDIO_TERMS = "admit admits admitted ask asks asked say says speaking speech sound audio music noise voice applause alarm".split()

COMMON_TRANSCRIPT_WORDS = "about after also and are as because but can different for from have in into is it of on or our that the their they this to we what with you".split()
VISUAL_QUERY_WORDS = "appear appears display displayed list lists on screen says shown slide text title".split()
OCR_FUNCTION_WORDS = "a an and as at be by do for from he i in is it of on or so the to we with".split()

PRESETS = {"aggressive": (6, 0.66, 10.0), "balanced": (12, 0.72, 14.0), "conservative": (24, 0.78, 18.0)}
TOKENS_PER_ITEM = {"generic": (258, 32), "gemini_default": (258, 32), "gemini_low_res": (66, 32)}

ANCHOR_MIN_RELEVANCE = 0.15
ANCHOR_RELATIVE_RELEVANCE = 0.6
ANCHOR_SIGMA = 8.0
ANCHOR_MIN_SCORE = 0.25
ANCHOR_RELEVANCE_BOOST = 0.1
ANCHOR_NORMALIZED_BOOST = 1.25
CROSS_MODAL_WEIGHT = 0.15
NEIGHBOR_GAP_SIGMAS = 0.75
NEIGHBOR_MIN_TOKENS = 5
NEIGHBOR_SIMILARITY = 0.35

MERGE_TEXT_WEIGHT = 0.35
MERGE_MIN_SIMILARITY = 0.35
MERGE_MIN_TEMPORAL = 0.1
MERGE_RATIO = 0.5
MERGE_MAX_GROUPS = 2

SEGMENT_SECONDS = 120.0
MAX_SEGMENTS = 12
VISUAL_RADIUS = 12.0
MIN_AUDIO_RELEVANCE = 0.12
MAX_AUDIO_MOMENTS = 8
SCENE_SIMILARITY = 0.82

WHY_ANSWER_TERMS = "afraid because chased chasing fear freaked nightmare nightmares reason scared".split()
MAX_DISPLAY_MOMENTS = 6
NEAR_DUPLICATE_TRANSCRIPT = 0.35

GLOBAL_ADMIN_TERMS = "assignment course evaluation exercise lecture objectives project schedule seminar tuesday week".split()
#: Technical words and what they are called as topics.
GLOBAL_TOPIC_LABELS = {
    "architecture": "architecture", "behavior": "behavior", "biomechanics": "biomechanics", "bio": "bio-inspired robotics", "biology": "biology", "control": "control", "data": "data", "design": "design tradeoffs",
    "efficiency": "efficiency", "feedback": "feedback", "intelligence": "intelligence", "legged": "legged locomotion", "learning": "learning", "locomotion": "locomotion", "machine": "machines", "machines": "machines",
    "model": "models", "motor": "motor control", "power": "power", "robot": "robotics", "robotics": "robotics", "sensor": "sensors", "sensors": "sensors", "system": "systems", "tradeoffs": "design tradeoffs", "velocity": "velocity",
}
GLOBAL_TOPIC_STOPWORDS = "about all also basically course courses covered covers final have lecture main many overview people place project research section seminar thing throughout topic topics video week weeks".split()
GLOBAL_FILLER_PHRASES = ["a lot of", "and then", "basically", "kind of", "so this is", "the interesting thing", "this role", "we have"]
GLOBAL_NOISE_PHRASES = ["interesting thing", "this role", "in the place", "in their library manner"]
VISUAL_STOPWORDS = "a an and at in is me of on screen show shown the to video what when where".split()
GLOBAL_TOPIC_OVERLAP = 0.65
GLOBAL_TOPIC_MIN_SCORE = 1.2
MAX_GLOBAL_TOPICS = 3

#: Preset -> (schema, priority, words of a task that suggest it).
EXTRACTION_PRESETS = {
    "customer-objections": ("customer_objections", 5, ["objection", "complain", "complaint", "concern", "blocker", "expensive", "pricing", "price", "too much", "security", "trust", "implementation"]),
    "feature-requests": ("feature_requests", 4, ["feature request", "requested feature", "ask for", "asked for", "need", "wish", "missing feature", "integration request", "workflow", "improvement", "automation", "reporting"]),
    "meeting-decisions": ("meeting_decisions", 3, ["decision", "decide", "action item", "follow up", "follow-up", "owner", "deadline", "due date", "open question", "risk", "assigned"]),
    "product-announcements": ("product_announcements", 2, ["announcement", "announce", "launch", "released", "new product", "new feature", "availability", "roadmap", "integration", "keynote", "demo"]),
    "sales-feedback": ("sales_feedback", 1, ["sales", "feedback", "demo feedback", "product mention", "positive reaction", "negative reaction", "buyer", "prospect", "customer reaction"]),
}
DEFAULT_PRESET = "sales-feedback"

#: Label quality: codes and their limits.
MAX_EXTRACTION_RATE = 0.9
MAX_DUPLICATE_RATE = 0.25
MAX_WEAK_FIELD_RATE = 0.35
MIN_TIMESTAMP_COVERAGE = 0.95
MIN_AVERAGE_CONFIDENCE = 0.45
DUPLICATE_ITEM_SIMILARITY = 0.72
TRANSCRIPT_QUALITY = ["fast", "balanced", "accurate"]

#: Words that keyword overlap ignores, and the word classes of extraction fields.
KEYWORD_STOP = "a an and for in is of on or the to with".split()
POSITIVE = "good great love strong positive works useful".split()
NEGATIVE = "bad expensive hate negative problem issue hard".split()
SEVERITY = {"high": "blocked blocker critical dealbreaker must risk".split(), "medium": "concern expensive hard issue problem slow".split(), "low": "maybe minor later".split()}
PRIORITY_TERMS = "blocker critical deadline expensive must need pain risk want".split()
PAIN_TERMS = ["can't", "cannot", "expensive", "friction", "hard", "issue", "pain", "problem", "slow", "too much"]
REQUESTER_PATTERNS = [r"\b(?:customer|buyer|prospect|user|founder|builder|team)\b", r"\b(?:i|we)\s+(?:need|want|wish|asked|care|would)\b"]
RESPONSES = [
    (["pricing"], "Clarify budget impact, ROI, and pricing flexibility."), (["security", "trust"], "Provide security, privacy, reliability, and accuracy evidence."),
    (["implementation", "integration"], "Follow up with implementation scope, integration plan, and owner."), (["timing"], "Clarify timeline, urgency, and next decision point."),
]
REQUEST_WORDS = "need want wish should".split()
REQUEST_RESPONSE = "Capture the requested workflow and confirm priority with the requester."
AUDIO_INTENTS = ["speech_semantic", "sound_event"]
VISUAL_INTENTS = ["visual_object_action"]
CARD_KEEP_RATIO = 0.55
CARD_PRE_CONTEXT_SECONDS = 30.0
MAX_CARDS = 3

# Fixed values of questions, keywords, answers and advice: they must equal those of the behaviour that this engine matches.

SPOKEN = "say says said tell tells told ask asks asked admit admits admitted explain explains explained presenter speaker".split()
EXACT_TEXT = ["on-screen text", "onscreen text", "screen text", "text says", "title says"]
WRITTEN = "text words caption written title logo label slide".split()
KEYWORD_STOPWORDS = "all and any about after again also answer are but because being clip does during evidence for from has have here his how its into like not our out she than that the their then there these they this those transcript was what when who where which why with would you your".split()
KEYWORD_FORMS = {"it's": "its", "that's": "that", "there's": "there", "they're": "they", "you're": "you"}
ROUTED_SPEECH = "ask asks asked mention mentions said say says speak speaker tell tells told".split()
ADVICE = [
    (["evidence_retrieval", "temporal_localization"], "Improve query-aware retrieval before changing answer generation."),
    (["evidence_retrieval"], "Tune candidate scoring, query decomposition, or scene/audio fusion."),
    (["temporal_localization"], "Adjust clip span, transcript anchoring, or temporal context expansion."),
    (["answer_grounding"], "Improve answer synthesis and citation pruning from selected evidence."),
    (["compression_budget"], "Tighten token estimation or reduce selected context budget."),
    (["evidence_pruning"], "Make answer-support pruning more selective."),
]
SEEN_WORDS = "appear appears display displayed look screen see show shown visible watch".split()
ENUMERATED_TOPICS = "startup startups ideas founders".split()
FOLLOWUP_TOPICS = "mistake kills kill".split()
SETUP_PHRASES = ["talking about", "have a listen", "let's listen", "question is", "what truly"]
FOLLOWUP_PHRASES = ["they make", "users don't like", "users do not like", "do not like", "don't like", "that is the killer", "the mistake"]
