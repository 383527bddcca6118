"""Words, versions and patterns that recognise cited sources."""

# Names a reasoning block may cite.
CITABLE_NAMES = [
    "Enterprise Network Design", "Network Design", "PCI-DSS", "HIPAA", "NIST", "ISO 27001",
    "SOX", "Cisco", "Juniper", "Arista", "BGP", "OSPF", "SD-WAN", "Zero Trust", "Topology",
    "Compliance", "TCO Model", "CapEx", "RFC", "CCDE", "Chapter", "Section", "Requirement",
    "Guide",
]

# A standard and the texts that count as naming its version.
STANDARD_VERSIONS = {
    "PCI-DSS": ["4.0.1", "4.0", "3.2.1"],
    "HIPAA": ["Security Rule", "Privacy Rule", "164.312"],
    "SOX": ["Section 302", "Section 404"],
    "NIST": ["CSF 2.0", "CSF 1.1", "800-53"],
}

# A knowledge domain and the titles that show it was cited.
DOMAIN_TITLES = {
    "enterprise_design": [
        "enterprise network design", "ccnp enterprise design", "ensld",
        "designing cisco network service architectures", "campus network",
    ],
    "routing": [
        "routing tcp/ip", "tcp/ip volume", "jeff doyle", "bgp design and implementation",
        "optimal routing design", "ospf anatomy",
    ],
    "data_center": [
        "vxlan bgp evpn", "building data centers", "ccnp dccor", "data center core",
        "trill fabricpath",
    ],
    "security": [
        "cisco asa", "network security architectures", "end to end network security",
        "firewall and ips design", "cvd firewall",
    ],
    "qos": ["end-to-end qos", "qos network design", "rfc 4594", "qos end to end"],
    "mpls": [
        "definitive mpls", "mpls design", "traffic engineering with mpls", "advanced mpls",
        "inter as mpls",
    ],
    "sd_wan": ["cisco software-defined wide area", "sd-wan", "dmvpn"],
    "ccde": ["ccde", "orhan ergun", "art of network architecture", "patterns in network"],
    "cloud": ["aws architect", "cloud computing", "hybrid cloud", "azure"],
}

# Words inside brackets that make the bracket a citation.
CITATION_WORDS = [
    "Design", "Guide", "RFC", "CCDE", "CCNP", "CCIE", "PCI", "HIPAA", "NIST", "IEEE", "Cisco",
]

# Terms that raise the confidence of a strictly parsed answer (case matters).
TECHNICAL_TERMS = ["OSPF", "BGP", "VXLAN", "MPLS", "PCI-DSS", "HA", "three-tier", "spine-leaf"]
