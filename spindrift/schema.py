"""The vocabulary of the graph: fixed values that column functions and SQL share."""

from __future__ import annotations

#: Relations.
RELATIONS = ["uses", "targets", "exploits", "delivers", "communicates_with", "drops", "attributed_to", "associated_with", "variant_of", "located_in", "mitigated_by", "related_to"]
#: Entity types.
ENTITY_TYPES = ["ThreatActor", "Malware", "Tool", "Campaign", "Vulnerability", "Technique", "Tactic", "Organization", "Location", "IOC", "File", "Infrastructure", "Software", "Other"]
#: Validation statuses.
STATUSES = ["raw", "validated", "repaired", "rejected"]
#: The catch-all relations.
GENERIC = ["related_to", "associated_with"]

#: Subject and object types that a relation allows; relations not named allow any.
TYPE_PAIRS = {
    "uses": (["ThreatActor", "Malware", "Campaign", "Tool", "Vulnerability", "Organization"], ["Malware", "Tool", "Technique", "Infrastructure", "IOC", "Software", "File", "Vulnerability"]),
    "targets": (["ThreatActor", "Malware", "Campaign", "Tool", "Vulnerability"], ["Organization", "Location", "Software", "Infrastructure", "IOC", "File", "Vulnerability", "Other", "Technique", "Campaign"]),
    "exploits": (["ThreatActor", "Malware", "Campaign", "Tool", "Vulnerability"], ["Vulnerability", "Software", "Infrastructure"]),
    "delivers": (["ThreatActor", "Malware", "Campaign", "Infrastructure", "IOC", "Vulnerability"], ["Malware", "File", "Tool"]),
    "communicates_with": (["Malware", "Tool"], ["IOC", "Infrastructure"]),
    "drops": (["Malware", "ThreatActor", "Campaign"], ["Malware", "File", "Tool", "IOC"]),
    "attributed_to": (["Malware", "Campaign", "Tool", "ThreatActor"], ["ThreatActor", "Organization", "Location"]),
    "variant_of": (["Malware", "Tool", "Vulnerability", "ThreatActor", "Campaign", "Technique"], ["Malware", "Tool", "Technique", "Other", "ThreatActor", "Campaign"]),
    "located_in": (["Organization", "ThreatActor", "Infrastructure", "Campaign", "Malware"], ["Location"]),
    "mitigated_by": (["Vulnerability", "Organization", "Software"], ["Tool", "Technique", "Software", "Organization"]),
}

#: Object types of the six-relation quality table.
QUALITY_OBJECTS = {
    "exploits": ["Vulnerability", "Software", "Infrastructure"],
    "attributed_to": ["ThreatActor", "Organization"],
    "communicates_with": ["IOC", "Infrastructure"],
    "variant_of": ["Malware", "Tool", "Technique", "Other"],
    "located_in": ["Location"],
    "mitigated_by": ["Organization", "Software", "Tool", "Other"],
}
#: The two relations that the structural table has besides.
STRUCTURAL_OBJECTS = QUALITY_OBJECTS | {"drops": ["File", "Malware", "Tool"], "delivers": ["File", "Malware", "Tool"]}

#: Entity types in STIX 2.1; Other has none.
STIX_TYPES = {
    "ThreatActor": "threat-actor", "Campaign": "campaign", "Malware": "malware", "Tool": "tool", "Technique": "attack-pattern", "Tactic": "attack-pattern",
    "Vulnerability": "vulnerability", "Organization": "identity", "Location": "location", "Infrastructure": "infrastructure", "IOC": "indicator", "File": "file", "Software": "software",
}
_ACTING = ["attack-pattern", "campaign", "intrusion-set", "malware", "threat-actor", "tool"]
#: STIX 2.1 source and target types of the relations that have a domain and range.
STIX_PAIRS = {
    "uses": (_ACTING, ["attack-pattern", "infrastructure", "malware", "tool"]),
    "targets": (_ACTING, ["identity", "location", "vulnerability"]),
    "exploits": (_ACTING, ["vulnerability"]),
    "attributed_to": (["campaign", "intrusion-set", "malware", "threat-actor"], ["intrusion-set", "threat-actor", "identity"]),
    "variant_of": (["malware"], ["malware"]),
    "communicates_with": (["infrastructure", "malware", "tool"], ["infrastructure", "indicator"]),
    "drops": (["malware", "threat-actor", "campaign", "intrusion-set"], ["malware", "tool", "file"]),
    "delivers": (["attack-pattern", "campaign", "infrastructure", "malware", "threat-actor", "intrusion-set", "indicator"], ["malware", "file", "tool"]),
    "located_in": (["identity", "infrastructure", "threat-actor", "campaign", "malware"], ["location"]),
    "mitigated_by": (["attack-pattern", "indicator", "malware", "tool", "vulnerability", "identity", "software"], ["identity", "software", "tool", "attack-pattern"]),
}

#: Relations that count as compatible in scoring, in either order.
COMPATIBLE = [
    ("uses", "targets"), ("uses", "drops"), ("uses", "delivers"), ("delivers", "drops"), ("associated_with", "attributed_to"), ("associated_with", "uses"),
    ("associated_with", "exploits"), ("variant_of", "associated_with"), ("targets", "exploits"), ("communicates_with", "uses"), ("exploits", "mitigated_by"),
    ("related_to", "uses"), ("related_to", "targets"), ("related_to", "associated_with"), ("related_to", "variant_of"), ("related_to", "attributed_to"),
]
#: The pairs that benchmark protocols add.
COMPATIBLE_WIDE = COMPATIBLE + [("attributed_to", "drops"), ("related_to", "mitigated_by"), ("exploits", "variant_of")]

#: Types that count as one in scoring.
TYPE_CLASSES = {"Tool": "Tool_SW_Mal", "Software": "Tool_SW_Mal", "Malware": "Tool_SW_Mal", "Technique": "Technique", "Tactic": "Technique", "Infrastructure": "Infra_IOC", "IOC": "Infra_IOC", "File": "Infra_IOC"}

#: The wordings of free relations that are known as such.
RELATION_WORDINGS = {
    "uses": [
        "uses", "use", "used", "is used by", "has started using", "leverages", "leveraged", "are using", "began using", "executes", "installs", "installed", "runs on", "switched to",
        "attempted to use", "is written in", "written in", "developed in", "built with", "coded in", "launches", "launched", "utilizes", "employs", "employed", "used by",
        "hired people specialized in", "enables", "allows", "allows attacker to", "intended to achieve", "can perform", "can execute", "performs", "provides", "is used for", "used for", "was used by",
        "operates",
    ],
    "targets": [
        "targets", "target", "targeted", "has targeted", "are targeting", "is targeting", "began targeting", "is attacking", "attacked", "attempts to stop", "attempts to delete", "stops", "deletes",
        "encrypts", "encrypted", "steals", "exfiltrates", "scans", "infects", "compromised", "compromises", "affects", "affected", "impacts", "impacted", "impersonated", "impersonates", "stole",
        "stolen", "included sectors", "modifies", "modified", "conducts", "conducted", "breached", "focuses on", "focused on", "collects", "harvests", "captures",
    ],
    "exploits": [
        "exploits", "exploit", "exploited", "exploiting", "are exploiting", "is exploiting", "have been exploiting", "attempt to exploit", "attempted to exploit", "abuses", "abused",
        "takes advantage of", "affected by", "has vulnerability", "is a vulnerability in", "exploited vulnerability in", "has exploited", "has been exploited",
    ],
    "delivers": ["delivers", "delivered", "deliver", "distribute", "distributed via", "distributed through", "attempted to deploy", "could propagate", "propagates"],
    "communicates_with": ["communicates_with", "communicates with", "connects to", "sends", "receives", "contacts", "beacons to", "calls back to", "resolves to"],
    "drops": ["drops", "dropped", "deploys", "deployed", "downloads", "downloaded", "downloads and installs", "loads", "loaded", "is deployed by", "was deployed"],
    "attributed_to": [
        "attributed to", "attributed_to", "is attributed to", "is behind", "is linked to", "linked to", "created", "created by", "developed by", "operated by", "maintained by", "was released by",
        "released by", "from", "is responsible for", "responsible for", "developed", "authored",
    ],
    "associated_with": [
        "associated with", "associated_with", "is associated with", "is connected to", "overlaps with", "shares similarities with", "is also known as", "also known as", "observed", "discovered",
        "identified", "found", "detected", "reported", "analyzed", "tracked", "monitors", "investigated", "is tracked as", "tracked as", "disclosed", "includes", "potentially connected to", "include",
        "contain", "contains", "has", "has been active since", "uncovered", "released", "released joint statement regarding", "include those manufactured by", "has been observed", "was observed",
        "is known for", "published", "issued", "warned about",
    ],
    "variant_of": ["variant of", "variant_of", "is a type of", "is successor of", "rebranded as", "is", "is a", "is a variant of", "had rebrands", "is classified as", "described as"],
    "located_in": ["located in", "located_in", "is based in", "are located in", "resided in", "hosted on", "hosted in", "operates in", "based in", "occurred in", "is located in"],
    "mitigated_by": ["mitigated by", "mitigated_by", "patched", "fixes", "addresses", "patched in", "recommended", "advises"],
}
#: Stems of free relations in the order in which they are tried.
RELATION_STEMS = [
    ("exploits", ["exploit", "abus", "takes advantage"]),
    ("targets", ["target", "attack", "infect", "compromis"]),
    ("uses", ["use", "using", "leverag", "employ", "utiliz", "switch"]),
    ("delivers", ["deliver", "distribut", "spread"]),
    ("drops", ["drop", "deploy", "download", "install", "load"]),
    ("attributed_to", ["attribut", "linked", "created by", "developed by", "operated by"]),
    ("associated_with", ["associat", "observ", "discover", "identif", "detect", "report", "track", "known as"]),
    ("located_in", ["locat", "based in", "hosted"]),
    ("mitigated_by", ["mitigat", "patch", "fix", "address", "remediat"]),
    ("variant_of", ["variant", "successor", "rebrand", "is a type"]),
    ("communicates_with", ["communicat", "connect", "beacon", "contact", "resolv"]),
    ("targets", ["encrypt", "steal", "exfiltrat", "scan", "delet", "stop", "affect", "impact"]),
    ("uses", ["written in", "coded in", "built with", "launch"]),
    ("associated_with", ["include", "contain"]),
    ("variant_of", ["classif", "describ"]),
    ("uses", ["perform", "conduct", "provid", "operat"]),
    ("targets", ["breach"]),
    ("exploits", ["vulnerab"]),
    ("targets", ["collect", "harvest", "captur", "focus"]),
    ("attributed_to", ["responsib", "author"]),
    ("mitigated_by", ["recommend", "advis"]),
    ("associated_with", ["publish", "issu", "warn", "uncov", "releas"]),
]
#: Stems by which a model's relation is resolved, with underscores for blanks.
MODEL_RELATION_STEMS = [
    ("exploits", ["exploit"]), ("targets", ["target"]), ("uses", ["use", "employ", "switch"]), ("delivers", ["deliver"]), ("drops", ["drop", "deploy"]),
    ("attributed_to", ["attribut"]), ("communicates_with", ["communicat"]), ("variant_of", ["variant", "version_of", "known_as", "rebrand"]), ("located_in", ["locat"]),
    ("mitigated_by", ["mitigat"]), ("associated_with", ["associat", "linked", "connected", "tied"]), ("targets", ["victim_of", "impacted_by"]),
    ("variant_of", ["classif", "described_as", "is_a_"]), ("associated_with", ["appear", "emerge"]), ("targets", ["infect", "compromis", "attack"]),
    ("attributed_to", ["creat", "develop", "author"]), ("variant_of", ["evolv", "fork"]),
]
#: Stems by which a model's entity type is resolved.
MODEL_TYPE_STEMS = [
    ("ThreatActor", ["threat", "actor", "apt", "attacker"]), ("Malware", ["malware", "ransomware", "trojan"]), ("Vulnerability", ["vuln", "cve"]), ("Technique", ["technique", "ttp"]),
    ("Tactic", ["tactic"]), ("Campaign", ["campaign", "operation"]), ("IOC", ["ioc", "indicator"]), ("Infrastructure", ["infra"]), ("Organization", ["org"]),
    ("Location", ["location", "country", "region"]), ("Tool", ["tool"]), ("File", ["file"]), ("Software", ["software"]),
]

#: Names that stand for no entity.
PLACEHOLDERS = [
    "attacker", "the attacker", "attackers", "the attackers", "threat actor", "the threat actor", "actor", "victim", "the victim", "target", "the target", "server", "the server",
    "malware", "the malware", "tool", "the tool", "file", "the file", "unknown", "n/a", "none", "they", "them", "their", "it", "its", "he", "she", "him", "her", "this", "these", "those",
    "we", "our", "the group", "the actor", "the campaign", "the malware family", "the vulnerability",
]
#: Objects that say nothing.
LOW_VALUE = ["known cybercrime organizations", "cybercrime organizations", "various sectors", "multiple services", "single attack", "malicious activity"]
#: Words for which a pronoun's antecedent is looked up.
PRONOUNS = [
    "they", "them", "it", "its", "he", "she", "the group", "the actor", "the actors", "the threat actor", "the threat actors", "the attacker", "the attackers", "the malware", "the ransomware",
    "the campaign", "the tool", "the operator", "the operators", "the hackers", "the hacker", "the adversary", "the adversaries", "attackers", "the gang", "government backed actors",
    "government-backed actors", "state-sponsored actors", "state sponsored actors", "threat actors", "threat actor",
]
#: Weights of relations in saliency.
SALIENCE = {
    "exploits": 1.0, "delivers": 0.95, "drops": 0.95, "targets": 0.9, "uses": 0.85, "attributed_to": 0.9, "communicates_with": 0.85, "mitigated_by": 0.8, "variant_of": 0.75,
    "located_in": 0.7, "associated_with": 0.5, "related_to": 0.3,
}

#: Names of techniques, which make an untyped name one.
TECHNIQUE_NAMES = [
    "credential dumping", "spear phishing", "spearphishing", "lateral movement", "privilege escalation", "dll sideloading", "dll side-loading", "dll injection", "process injection",
    "command and control", "data exfiltration", "keylogging", "screen capture", "brute force", "pass the hash", "pass the ticket", "phishing", "watering hole", "supply chain", "code signing",
    "obfuscation", "rootkit", "living off the land", "lolbin", "registry modification", "scheduled task", "persistence", "defense evasion", "initial access", "execution", "discovery",
    "collection", "impact", "resource development", "social engineering", "drive-by compromise", "exploit public-facing",
]
#: Parts of names of techniques of encryption.
CRYPTO_HINTS = ["aes", "rsa", "ctr", "cbc", "gcm", "encryption", "cipher", "key exchange"]
#: Parts of names of campaigns.
CAMPAIGN_HINTS = ["campaign", "operation", "project"]
#: Parts of names of actors.
ACTOR_HINTS = ["apt", "group", "gang", "hacker", "team", "bear", "panda", "kitten", "spider", "typhoon", "sandworm", "lazarus"]
#: Software and platforms; a name that shares a word with one of them is software.
SOFTWARE_NAMES = [
    "windows", "linux", "macos", "mac os", "ios", "android", "chrome", "firefox", "safari", "edge", "opera", "microsoft office", "outlook", "exchange", "sharepoint",
    "python", "java", "rust", "c++", "c#", ".net", "vmware", "citrix", "oracle", "sap", "cisco", "adobe", "wordpress", "apache", "nginx", "iis",
]
#: Further words in evidence that decide between relations.
EXPLOITED_HINTS = ["exploit", "abuse", "attack", "compromise"]
FOUND_HINTS = ["discover", "found", "report", "analyz", "identif", "observ", "track"]
TIED_HINTS = ["linked", "tied", "connected", "operated", "backed"]
WIELDED_HINTS = ["deploy", "wield", "operate"]
#: Names in the spelling they are known by.
KNOWN_CASING = {
    "cobalt strike": "Cobalt Strike", "mimikatz": "Mimikatz", "metasploit": "Metasploit", "emotet": "Emotet", "trickbot": "TrickBot", "ryuk": "Ryuk", "conti": "Conti", "lockbit": "LockBit",
    "revil": "REvil", "darkside": "DarkSide", "blackcat": "BlackCat", "alphv": "ALPHV", "blackmatter": "BlackMatter", "ragnarlocker": "RagnarLocker", "wannacry": "WannaCry", "notpetya": "NotPetya",
    "stuxnet": "Stuxnet", "lazarus": "Lazarus Group", "lazarus group": "Lazarus Group", "apt28": "APT28", "apt29": "APT29", "apt41": "APT41", "fin7": "FIN7", "fin11": "FIN11", "fin12": "FIN12",
    "sandworm": "Sandworm", "turla": "Turla", "kimsuky": "Kimsuky", "powershell": "PowerShell", "psexec": "PsExec", "bloodhound": "BloodHound", "nmap": "Nmap", "windows": "Windows", "linux": "Linux",
    "macos": "macOS", "exchange": "Microsoft Exchange", "microsoft exchange": "Microsoft Exchange",
}
#: Words in evidence that show a vulnerability was disclosed, not exploited.
DISCLOSURE_HINTS = ["disclos", "reported", "tracked as", "research", "researchers", "discovered", "identified", "observed"]

#: Words in evidence that point to a relation.
HINTS = {
    "uses": ["used", "using", "leverag", "employ", "written in", "built with", "utiliz", "execut", "ran ", "runs ", "running", "psexec", "powershell", "cobalt strike"],
    "exploits": ["exploit", "abuse", "vulnerability", "cve-", "take advantage", "zero-day", "0-day"],
    "targets": ["target", "victim", "against", "encrypt", "steal", "exfiltrat", "compromis", "affect", "attack", "infect", "breach", "intrusion into", "directed at", "stop", "shut", "disabl", "wipe", "destroy", "delet", "disrupt", "lock", "render", "hit ", "victimized", "victims in", "targets in"],
    "delivers": ["deliver", "distribut", "payload", "dropper", "sent", "propagat", "spread", "phish"],
    "drops": ["drop", "download", "deploy", "install", "load", "write to disk", "side-load", "sideload"],
    "communicates_with": ["communicat", "beacon", "contact", "connect", "c2", "command and control", "callback", "phone home", "resolv"],
    "attributed_to": ["attribut", "linked to", "behind", "operated by", "created by", "developed by", "responsible for", "traced to", "associated with the group"],
    "located_in": ["located in", "based in", "hosted in", "operates in", "originat"],
    "mitigated_by": ["patch", "fix", "mitigat", "address", "remediat", "update"],
    "associated_with": ["linked to", "associated with", "connected to", "related to", "observed", "seen", "discovered", "confirmed", "classified", "described as"],
    "variant_of": ["variant", "family", "type of", "rebrand", "successor", "evolved from", "fork of", "based on", "is a ", "classified as", "categorized as", "form of", "known as", "also called", "renamed", "rebranded", "previously known", "formerly"],
}
