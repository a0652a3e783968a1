"""Cases with known results, by query. Expected texts state the required behaviour; none is our own output."""

from __future__ import annotations

PROMPT = (
    "语音转写：说话人只说中文和英文，以中文为主。结合上下文纠正同音错别字，人名、地名尽量准确。"
    "注意：若听到指令词“发送”或“clear”，把它作为独立的指令单独成句，并在指令词处触发断句。"
)

#: Whole clean-up: organizer, prompt, strip the end, cases (input, expected; None: unchanged).
FINALIZE: dict[str, tuple[str, str, bool, list[tuple[str, str | None]]]] = {
    "finalize_rule": ("rule", "", True, [
        ("", ""),
        ("这一段\n说的是同一个意思。\n后面还有一句", None),
        ("用 API\n做转写", None),
        ("Hello World.\nNext line.", "Hello World.\nNext line"),
        ("嗯，第一点买牛奶\n呃，第二点买鸡蛋", "第一点买牛奶\n第2点买鸡蛋"),
        ("一、买牛奶\n二、买鸡蛋", None),
        ("那官方的呃飞猪云很好用", "那官方的飞猪云很好用"),
        ("版本啊嗯而且我们要改", "版本，而且我们要改"),
        ("！", ""),
        ("language Chinese<asr_text>。", ""),
        ("谢谢！", "谢谢"),
        ("太好了！！", "太好了"),
        ("他说“你好。”", "他说“你好”"),
        ("language English<asr_text>clear the screen", "clear the screen"),
        ("明天下午三点开会", "明天下午3点开会"),
        ("买了三十五份材料", "买了35份材料"),
        ("上传的是 M P 四文件", "上传的是 MP4文件"),
        ("MP 四 和 MP 三", "MP4 和 MP3"),
        ("用 API 一下这个接口", None),
        ("中台和上云 API 的这这一块也是可以变的呀", "中台和上云 API 的这一块也是可以变的呀"),
        ("我我觉得有有问题", "我觉得有问题"),
        ("这、这、，我觉得这个它是一块儿内容呀。", "我觉得这个它是一块儿内容呀"),
        ("他说这、这、对", "他说这，对"),
        ("进可。可能靠前", "进可能靠前"),
        ("这个可可能明显是重复", "这个可能明显是重复"),
        ("这。这。", "这。这"),
        ("妈妈看看刚刚买的书", None),
        ("可可西里的风景", None),
        ("可可豆很好吃", None),
        ("发松", "发送"),
        ("法送一下", "发送一下"),
        ("可丽儿", "clear"),
        ("claer", "clear"),
        ("Claire", "clear"),
        ("please C L E A R now", "please clear now"),
        ("奥格猫抖的 org mode 配置", None),
    ]),
    "finalize_none": ("none", "", True, [
        ("第一点买牛奶", None),
        ("no way!", "no way"),
        ("百分之三十", "30%"),
        ("二〇二五年三月五号", "2025年3月5号"),
        ("这一块地方", None),
        ("两块石头", None),
        ("一块钱", "1块钱"),
        ("三十五块", "35块"),
    ]),
    "finalize_prompt": ("rule", PROMPT, True, [(PROMPT, ""), ("你好今天天气不错", None)]),
    "finalize_keep_punct": ("rule", "", False, [("你好。", None), (PROMPT, None)]),
}

#: Single operators: cases (input, expected; None: unchanged).
OPERATORS: dict[str, list[tuple[str, str | None]]] = {
    "strong_stutter": [("进可。可能靠前", "进可能靠前"), ("这。这。", None), ("这。可可豆", None)],
    "stutter": [
        ("我我觉得有有问题", "我觉得有问题"), ("这、这、，我觉得", "我觉得"), ("他说这、这、对", "他说这，对"), ("可可西里的风景", None),
        ("可可豆很好吃", None), ("妈妈看看", None), ("这这这一块", "这一块"), ("第一行\n这、这、，走", "第一行\n走"),
    ],
    "phrase_fillers": [("哎呀，走吧", "，走吧"), ("哎哟好疼", None), ("就是说，好", "，好"), ("他也就是说说", None)],
    "deictic_run": [("这个这个，好", "，好"), ("那个这个 好", " 好"), ("拿这个来", None)],
    "deictic_single": [("那个，我们先走", "，我们先走"), ("就选那个。", None), ("拿这个来", None)],
    "interjection_clusters": [
        ("官方的呃飞猪云", "官方的飞猪云"), ("版本啊嗯而且", "版本，而且"), ("贡献了啊然后", "贡献了，然后"), ("好的啊", None), ("三点了啊", None),
        ("啊那官方", "那官方"), ("哎哟好疼", None), ("嗯，好", "，好"), ("我说啊，这个不行", None), ("哎呦好疼", "呦好疼"), ("走啊哦哦。", "走。"),
    ],
    "topic_tail": [("火啊这个", "火啊"), ("火啊这个好", None), ("火啊那个。", "火啊。")],
    "filter_fillers": [("那官方的呃飞猪云很好用", "那官方的飞猪云很好用"), ("好。嗯。走。", "好。走。"), ("um, I uh think", "I think"), ("uhh", None)],
    "clause_connectors": [("而且好", "true"), ("然后呢", "true"), ("我然后", "false"), ("", "false")],
    "to_digits": [
        ("十", "10"), ("三十五", "35"), ("二千五百", "2500"), ("一百零五", "105"), ("三万二千", "32000"), ("二〇二五", "2025"), ("百", "100"), ("两", "2"),
    ],
    "acronym_digits": [("M P 四", "MP4"), ("MP 四", "MP4"), ("MP四", "MP4"), ("API 一下", None), ("A 四", None), ("done MP 四", "done MP4")],
    "clock_times": [
        ("三点五十分", "3点50分"), ("下午两点半", "下午2点半"), ("第一点", None), ("第二点", "第2点"), ("一点八秒", "1.8秒"), ("九点八分", "9.8分"),
        ("三点零五分", "3点05分"), ("一点八五", "1.85"), ("十一点十五分", "11点15分"), ("有一点累", None), ("三点五十", "3点50"), ("十点五元", "10.5元"),
    ],
    "percent": [("百分之三十到百分之五十", "30%到50%"), ("百分之三十", "30%"), ("百分之百", "100%")],
    "units": [("二〇二五年三月五号", "2025年3月5号"), ("三月", "3月"), ("十二日", "12日")],
    "money": [("一块钱", "1块钱"), ("五毛", "5毛"), ("三十五块", "35块"), ("这一块地方", None), ("两块石头", None), ("二千五百块钱", "2500块钱")],
    "composite_numbers": [("买了三十五份", "买了35份"), ("一共有五十六个", "一共有56个"), ("星期五", None), ("三十一起去", "30一起去"), ("一个", None), ("乱七八糟", None), ("三万二千", "32000")],
    "normalize_digits": [
        ("现在是早上三点五十分", "现在是早上3点50分"), ("下午两点半开会", "下午2点半开会"), ("三十五份材料", "35份材料"), ("二千五百块钱", "2500块钱"),
        ("百分之三十到百分之五十", "30%到50%"), ("二〇二五年三月五号", "2025年3月5号"), ("我一共有五十六个", "我一共有56个"), ("三个人", None),
    ],
    "spelled_letters": [("C L E A R", "CLEAR"), ("o r g model", "org model"), ("a b", None), ("say A B C now", "say ABC now"), ("A1 B C", None)],
    "cjk_ascii_spacing": [("用API做", "用 API 做"), ("用 API 做", None), ("API", None)],
    "ascii_phrases": [("用org  Model写", "用 org model 写"), ("orgmodels", None), ("o r g model", "org model"), ("og model!", "org model!")],
    "cjk_aliases": [("发松", "发送"), ("说可丽儿吧", "说 clear 吧"), ("可丽儿可丽儿", "clear  clear")],
    "normalize_commands": [("please C L E A R now", "please clear now"), ("法送一下", "发送一下"), ("Clare", "clear"), ("奥格猫抖的 org mode 配置", None)],
}
