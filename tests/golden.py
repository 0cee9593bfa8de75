"""Public example frames and a log, as they go over the wire, in hex."""

GPI = "fd1c0000070101210000d20400002227cc1756ff961350f80c00d43000009600b5ff14007869bcc6"
SYS = "fd1f000007010101000000000000000000000000000000007030f40100000000000000000000000012c9bf"
HUD = "fd1300000701014a000000004841000030410080f7420000c0bf5a004b91cd"
ATT = "fd0800000701011e0000000000000000803e77cc"
HEARTBEAT = "fd01000007010100000000dbb0"
HK_LOG = "0a0a496e69742063617073756c65206275696c6420303230300a484b0101080000000000020301ee61484b010229dc0500000280e6c5470000c03f0000c8410000c441000020420000d04100002842cdcc3c416666663feabc484b01484b010324400600000ad7233c0ad7a3bcc3f51c416f12833a6f1203bba69b443b0000a03f000000bfa694484b010229dc050000fd80e6c5470000c03f0000c8410000c441000020420000d04100002842cdcc3c416666663feabc484b010423a4060000342f87dd77f6434098f90e7ee26e4040008054440000604000a087430b0301cbdb00ff00ff484b0105083408000002030000ed89484b010324400600000ad7233c0ad7a3bcc3f51c"
