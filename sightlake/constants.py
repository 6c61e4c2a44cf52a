"""Values that results depend on. Everything here is a fixed value, not logic."""

# --- fixed values: assessment heads, in output order, with their class counts
HEAD_CLASS_COUNTS = {
    "severe_hemorrhage": 2,
    "respiratory_distress": 2,
    "trauma_head": 2,
    "trauma_torso": 2,
    "trauma_upper_ext": 3,
    "trauma_lower_ext": 3,
    "alertness_ocular": 3,
    "person_type": 2,
}
HEADS = tuple(HEAD_CLASS_COUNTS)

# --- fixed values: label text by head and class id
HEAD_LABELS = {
    "severe_hemorrhage": {0: "hem-", 1: "hem+", 2: "hem?"},
    "respiratory_distress": {0: "resp-", 1: "resp+", 2: "resp?"},
    "trauma_head": {0: "head-", 1: "head+", 3: "head?"},
    "trauma_torso": {0: "torso-", 1: "torso+", 3: "torso?"},
    "trauma_upper_ext": {0: "upper-", 1: "upper+", 2: "upper_amp", 4: "upper?"},
    "trauma_lower_ext": {0: "lower-", 1: "lower+", 2: "lower_amp", 4: "lower?"},
    "alertness_ocular": {0: "eyes_open", 1: "eyes_closed", 2: "eyes_nt", 3: "eyes?"},
    "person_type": {0: "manikin", 1: "human", 2: "type?"},
}

# --- fixed values: which heads share a display row, top to bottom
DISPLAY_ROWS = (
    ("person_type", "severe_hemorrhage", "respiratory_distress"),
    ("trauma_head", "trauma_torso"),
    ("trauma_upper_ext", "trauma_lower_ext", "alertness_ocular"),
)

# --- fixed values: detector classes, line number = class id
DETECTOR_CLASSES = (
    "person", "bicycle", "car", "motorcycle", "airplane", "bus", "train", "truck", "boat",
    "traffic light", "fire hydrant", "stop sign", "parking meter", "bench", "bird", "cat",
    "dog", "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe", "backpack",
    "umbrella", "handbag", "tie", "suitcase", "frisbee", "skis", "snowboard", "sports ball",
    "kite", "baseball bat", "baseball glove", "skateboard", "surfboard", "tennis racket",
    "bottle", "wine glass", "cup", "fork", "knife", "spoon", "bowl", "banana", "apple",
    "sandwich", "orange", "broccoli", "carrot", "hot dog", "pizza", "donut", "cake", "chair",
    "couch", "potted plant", "bed", "dining table", "toilet", "tv", "laptop", "mouse",
    "remote", "keyboard", "cell phone", "microwave", "oven", "toaster", "sink", "refrigerator",
    "book", "clock", "vase", "scissors", "teddy bear", "hair drier", "toothbrush",
)
PERSON_CLASS_ID = 0
PERSON_CLASS_NAME = "person"

# --- fixed values: thresholds and sizes of the deployed configuration
DEFAULT_CONFIDENCE = 0.2
NMS_IOU = 0.45
NMS_TOP_K = 300
MIN_ASSESS_SIDE = 8
DETECTOR_ID = 1
ASSESSOR_ID = 2
ASSESS_BATCH = 8
IMAGE_WIDTH = 640
IMAGE_HEIGHT = 368
MODEL_STRIDE = 32
RETAIN_TIMESTAMPS = 2048
RETAIN_METADATA = 512
RETAIN_MARKS = 2048

# --- fixed values: clocks and id ranges
NTP_TO_UNIX_SECONDS = 2_208_988_800
NS_PER_SECOND = 1_000_000_000
INT32_MAX = 2_147_483_647

# --- fixed values: confidence colour ramp and overlay geometry
RAMP_TOP = 0.8
RAMP_MIN_SPAN = 1e-6
DEFAULT_FRAME_HEIGHT = 1080
LINE_WIDTH = 3
FONT_SCALE = 0.001
MIN_TEXT_HEIGHT = 18
TEXT_GAP = 8

# --- fixed values: image encoder input normalisation (per RGB channel)
CHANNEL_SCALE = 0.00392156862745098
CHANNEL_MEAN = (0.48145466, 0.4578275, 0.40821073)
CHANNEL_STD = (0.26862954, 0.26130258, 0.27577711)
MIN_NORM = 1e-6

# --- fixed values: message fields
DETECTION_SOURCE = "DETECTION_YOLO"
ANNOTATION_PREFIX = "clip_rgb_"
DEFAULT_FORMAT = "jpeg"

STAGES = ("mux", "infer", "assessment", "convert", "osd", "sink")
BRANCHES = ("IMAGE", "DETECT", "ASSESS")
TOPICS = {"IMAGE": "image", "DETECT": "target_detections", "ASSESS": "casualty"}

FRAME_KEYS = ("stream_id", "frame")
