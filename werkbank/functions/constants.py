"""Fixed values that results depend on."""

# Component groups counted as PC components.
COMPONENT_GROUPS = ("TW", "GC", "CP", "NW", "ME", "HD", "MB", "PS", "FA", "OP")

# Channels, postcode, warehouse and customers that mark internal documents.
INTERNAL_CHANNELS = (23, 0, 28)
INTERNAL_POSTCODE = "10997"
INTERNAL_CONTRACT = -1
SALES_WAREHOUSE = 100
INTERNAL_CUSTOMER = "K000000"
INTERNAL_WORKSHOP_CUSTOMERS = ("K10000", "DE00000", "K000000")
OWN_SHOP_CHANNEL = 8

# Lifecycle state -> (document type, status).
LIFECYCLE = {
    "confirmed_workshop": ("D", 0),
    "in_production": ("L", 0),
    "ready_or_sent": ("R", 0),
}

# Fixed values: (type, status, type label, status label, state, state label, is current).
ORDER_STATES = (
    ("D", 0, "Werkstattschein", "Active", "confirmed_workshop",
     "Confirmed and at workshop stage", True),
    ("D", 2, "Werkstattschein", "Completed", "workshop_stage_completed",
     "Workshop stage completed", False),
    ("L", 0, "Lieferschein", "Active", "in_production",
     "Currently in production", True),
    ("L", 2, "Lieferschein", "Completed", "production_completed",
     "Production stage completed", False),
    ("R", 0, "Rechnung", "Final stage", "ready_or_sent",
     "Ready for shipment, invoiced, or already shipped", True),
)

# Case manufacturer -> models.
CASE_MODELS = {
    "Aerocool": ["P7-C1BG"],
    "Akasa": ["Euler"],
    "Antec": ["GX505"],
    "Artic Cooling": ["Silentium Pro"],
    "ASUS": ["ProArt PA401 Wood Edition TG Panel"],
    "ATX": ["Open Chassis"],
    "be quiet!": ["Light Base 500 LX Black", "Pure Base 500 White", "Pure Base 501 Airflow",
                  "Pure Base 501 Black", "Pure Base 501 LX White", "Pure Base 600"],
    "BitFenix": ["Nova TG", "Portal Windows"],
    "Chieftec": ["BU-12B-300", "FI-01B-U3"],
    "Compucase": ["8K01BS-SA120U"],
    "CoolerMaster": ["CD600 Black", "Elite 302", "Elite 490", "Elite 681", "MasterBox 600",
                     "MasterBox MB511 RGB", "MasterBox NR200-Black",
                     "MasterBox NR200P-Cyan/Glass", "MasterBox NR200P-Orange/Gla",
                     "MasterBox NR200P-Purple/Gl", "MasterBox NR200P-White",
                     "MasterBox SL600M", "MasterCase H500P", "MasterFrame 600 Black",
                     "Silencio S600 Metal"],
    "Corsair": ["Carbide Air 540", "Obsidian 500D"],
    "Cougar": ["QBX"],
    "Deepcool": ["CC560 MESH V2", "CG530 4F", "CH260", "CH260 Wood", "CH270 Digital",
                 "CH360 Digital", "CH510 Mesh Digital", "CH560 Digital", "CH690 Digital Black",
                 "CH690 Digital White", "Genome Black/red V2", "GENOME III",
                 "MATREXX 55 MESH V4 C", "MATREXX55 V3 White ADD-RGB 3F"],
    "Fractal Design": ["Define C TG", "Define Nano S Mini-ITX", "North Chalk TG white",
                       "North Charcoal TG Black", "North Momentum Black Edit",
                       "Torrent Black TG Dark Tin", "Torrent Compact TG Light"],
    "Fractal": ["North Meshify 3 XL Solid", "North XL Charcoal Black",
                "North XL Charcoal White"],
    "GameMax": ["Contac COC Black/Grey"],
    "HYTE": ["X50 Black", "X50 Snow White"],
    "Jonsbo": ["T9 silver"],
    "Kolink": ["Aviator Red Light", "KLA-002", "Punisher RGB"],
    "LC-Power": ["lc-1340mi", "lc-1350mi"],
    "Lian-Li": ["A3- Black", "A3- Black Wood Edition", "A3- White", "O11 Dynamic EVO",
                "PC-Q11B"],
    "mITX": ["Newton UCFF (intel NUC)", "ST-F7CB EVO"],
    "MSI": ["MAG FORGE M100R", "MAG PANO M100R PZ", "MPG GUNGNIR 110R", "MPG GUNGNIR 300R",
            "MPG GUNGNIR 300R White"],
    "MS-TECH": ["CA-0280"],
    "NZXT": ["H210i", "H510 Black", "H510 White", "Manta"],
    "PHANTEKS": ["Evolv Series X2", "XT M3 RGB"],
    "Q2": ["Illuminator blue"],
    "Q-Bi": ["Platoon Leader"],
    "RAIJINTEK": ["Arcadia III MS4"],
    "Sharkoon": ["Shark Zone C10", "TG5 RGB", "TG6 RGB", "VG6-W Blue", "VS4-V"],
    "Signum": ["SG1X TG RGB Black"],
    "SilverStone": ["SST-ML08B"],
    "Streacom": ["ST-F7C CB"],
    "Zalman": ["I3 Neo ARGB Black", "I3 Neo Black", "I4 White", "P30 Black",
               "P30 Black&White", "P30 White", "P50 DS Black", "P50 DS White", "P60 Black",
               "Z1 Neo"],
}
