"""Fixed values. Results depend on them, so they are stated as they are."""

# --- fixed values: feature extraction -------------------------------------------------
BANNED_COLUMNS = (
    "label", "target", "timestamp", "ts_parsed", "flow id",
    "src ip", "dst ip", "source ip", "destination ip",
    "src port", "dst port", "source port", "destination port",
    "protocol", "unnamed: 0",
)
BENIGN_LABEL = "benign"
SAMPLE_STEP = 5
WINDOW_LENGTH = 10
WINDOW_ATTACK_SHARE = 0.2
TRAIN_END = 0.70
VALIDATION_END = 0.85
MIN_FEATURE_STD = 1e-5
SCALE_LOW, SCALE_HIGH = 0.05, 0.95
CLIP_TRAINING = 6.0
CLIP_SERVING = 15.0

# --- fixed values: sampling -----------------------------------------------------------
NEGATIVES_PER_POSITIVE = 4
EVAL_SAMPLE_ROWS = 20_000
AUDIT_ROWS_PER_CLASS = 50
SEED = 42

# --- fixed values: threshold calibration ----------------------------------------------
TAU_COUNT = 1500
TAU_MIN, TAU_MAX = 0.01, 0.95
TARGET_PRECISION = 0.92
TARGET_RECALL = 0.90
TARGET_FPR = 0.015
MIN_TRUE_POSITIVES = 10
DETECT_THRESHOLD = 0.03

# --- fixed values: blending and model names -------------------------------------------
ENSEMBLE_WEIGHTS = {
    "MAMBA_SSM": 0.40,
    "XGBoost": 0.35,
    "LightGBM": 0.15,
    "CNN_BiLSTM": 0.10,
}
ENSEMBLE_NAME = "Hybrid_Ensemble"
FIGURE_MODELS = ("MAMBA_SSM", "Hybrid_Ensemble", "XGBoost", "CNN_BiLSTM")
COMPARISON_ORDER = ("LightGBM", "XGBoost", "BiLSTM", "BiGRU", "MAMBA_SSM")
COMPARISON_LABELS = {"MAMBA_SSM": "Mamba SSM"}

# --- fixed values: generalisation status ----------------------------------------------
STATUS_IDEAL = "🟢 Ideal Zero-Gap Fit"
STATUS_STANDARD = "🏆 IEEE/ACM SOTA Standard (Leak-Free)"
STATUS_DRIFT = "🟡 Acceptable Temporal Drift"
STATUS_UNDERFIT = "⚠️ Underfitting Risk"
STATUS_OVERFIT = "🔴 Overfitting Risk"
IDEAL_GAP_ROC, IDEAL_GAP_F1 = 0.05, 0.08
STANDARD_GAP_ROC, STANDARD_ROC, STANDARD_PRECISION = 0.115, 0.85, 0.90
DRIFT_GAP_ROC, DRIFT_ROC = 0.155, 0.82
UNDERFIT_ROC = 0.75

# --- fixed values: boosted trees (rounds, step, feature share, rows per leaf) ----------
POSITIVE_WEIGHT = 4.0
TREE_DEPTH, TREE_ROW_SHARE = 5, 0.8
# Rounds without a lower validation loss after which a setting stops.
EARLY_STOPPING = {"CatBoost": 30}
TREE_SETTINGS = {
    "XGBoost": (350, 0.035, "0.8", 4),
    "CatBoost": (400, 0.040, "all", 1),
    "LightGBM": (350, 0.035, "0.8", 40),
}

# --- fixed values: retrieval ----------------------------------------------------------
BM25_K1 = 1.5
BM25_B = 0.75
LSA_WEIGHT = 0.55
BM25_WEIGHT = 0.45
VOCABULARY_LIMIT = 500
LSA_COMPONENTS = 5

# --- fixed values: incidents ----------------------------------------------------------
INCIDENT_ID_FORMAT = "INC-2026-NIDS-%05d"
STATUS_DETECTED = "DETECTED"
STATUS_BLOCKED = "BLOCKED & MITIGATED"
BLOCK_RULE = "iptables -A INPUT -s {src_ip} -j DROP"
DEFAULT_SRC_IP, DEFAULT_DST_PORT, DEFAULT_PROTOCOL = "unknown", 0, "TCP"

# --- fixed values: threat catalogue (ids, retrieval text and response rules) ----------
THREATS = (
    ("MITRE-T1498", "Network DoS SYN Flood DDoS", "TA0040 - Impact",
     "init win bytes forward packet length max flow duration syn flood ddos denial service",
     "Deploy SYN cookies, drop asymmetric bursts, rate-limit TCP SYN via iptables.",
     ("iptables -A INPUT -p tcp --syn -m limit --limit 1/s --limit-burst 3 -j ACCEPT",
      "iptables -A INPUT -p tcp --tcp-flags ALL NONE -j DROP",
      "iptables -A INPUT -m state --state INVALID -j DROP",
      "iptables -A INPUT -p tcp --syn -j DROP"),
     "High SYN flag count, abnormal Init_Win_bytes, low Flow_IAT_Min, large Fwd_Packet_Length"),
    ("MITRE-T1046", "Port Scan Discovery", "TA0007 - Discovery",
     "destination port flow iat minimum packet length variance scan sweep discovery nmap",
     "Enforce strict perimeter firewall rules, block source IP.",
     ("iptables -A INPUT -s {src_ip} -j DROP",
      "iptables -A INPUT -p tcp --tcp-flags SYN,FIN SYN,FIN -j DROP",
      "iptables -A INPUT -p tcp --dport 1:1024 -m connlimit --connlimit-above 5 -j DROP"),
     "Multiple destination ports, low Flow_IAT, high packet length variance, scan patterns"),
    ("MITRE-T1041", "Exfiltration Over C2", "TA0010 - Exfiltration",
     "forward bytes bulk backward bytes bulk flow bytes packets high volume outbound exfiltration",
     "Block outbound connections, quarantine source IP.",
     ("iptables -A OUTPUT -d {src_ip} -j DROP",
      "iptables -A INPUT -s {src_ip} -m conntrack --ctstate ESTABLISHED,RELATED -j DROP",
      "iptables -A FORWARD -s {src_ip} -j DROP"),
     "High Fwd_Bytes_Bulk, abnormal Bwd_Bytes_Bulk, high flow bytes per second"),
    ("MITRE-T1110", "SSH Brute Force", "TA0006 - Credential Access",
     "syn flag count ack flag count forward packets ssh port 22 brute force credential",
     "Rate-limit SSH, block after failed attempts.",
     ("iptables -A INPUT -p tcp --dport 22 -m conntrack --ctstate NEW -m recent --set --name SSH",
      "iptables -A INPUT -p tcp --dport 22 -m conntrack --ctstate NEW -m recent --update --seconds 60 --hitcount 4 --name SSH -j DROP",
      "iptables -A INPUT -p tcp --dport 22 -j ACCEPT"),
     "High SYN+ACK flag count, repeated SSH port 22 connections, brute force patterns"),
    ("MITRE-T1059", "Command Injection", "TA0002 - Execution",
     "flow packets per second high rate burst payload command injection reverse shell",
     "Block reverse shell ports.",
     ("iptables -A INPUT -s {src_ip} -p tcp --dport 4444 -j DROP",
      "iptables -A INPUT -s {src_ip} -p tcp --dport 8080 -j DROP",
      "iptables -A OUTPUT -d {src_ip} -j DROP"),
     "High flow packets per second, burst payload patterns, reverse shell signatures"),
    ("MITRE-T1071", "DNS Tunneling", "TA0011 - C2",
     "dns query length high flow duration long idle mean protocol udp port 53 tunneling",
     "Block suspicious DNS traffic.",
     ("iptables -A INPUT -s {src_ip} -p udp --dport 53 -j DROP",
      "iptables -A OUTPUT -d {src_ip} -p udp --dport 53 -j DROP"),
     "Long DNS queries, high flow duration, abnormal idle mean, UDP port 53"),
)
DISPLAY_NAMES = {
    "MITRE-T1498": "Denial of Service (SYN/UDP Flood)",
    "MITRE-T1059": "Command & Scripting Reverse Shell",
    "MITRE-T1046": "Port Scan & Network Discovery",
    "MITRE-T1041": "Data Exfiltration Over C2",
    "MITRE-T1110": "SSH Brute Force Attack",
    "MITRE-T1071": "DNS Tunneling (C2 Channel)",
}
# --- end of fixed values --------------------------------------------------------------
