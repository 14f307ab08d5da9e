"""Digests of further whole licence texts in the canonical form of `licenses` (md5), by SPDX name.

Made from copies of the texts as software packages distribute them: as they stand, with the lines of a paragraph
joined, and without what follows the end of the terms; MIT, ISC and BSD also with their usual titles.
"""

DIGESTS = {
    "0BSD": [
        "fa9583358e39e30cc008a801c940fa8c",
    ],
    "Apache-2.0": [
        "061d2aacf2bc5f6895431599003e003c",
        "0b86eecc1e7d2e8a032c6949313ee428",
        "11126b2fe3260ba89f3cc1853190e911",
        "386365ad0a10911570a5304e1d37f88c",
        "43ea289ea3b390262706d9889c10fdc2",
        "462b4643051b3374d99785d5ab735a02",
        "601334e7aaea61bc579af33870120bf8",
        "77469d4d099f91629686d95432809c04",
        "7c9bb8c526ba794d83ba7e517185405e",
        "7f1e686842839e3228de457bd950eefd",
        "8c62bfe577b2bfbb53bdb054a5a22b8a",
        "8f86909a6dbf3a124c7a7d11b3aaf31f",
        "972f3ddcb29133c5bec777100928f87b",
        "ad457db252f5a5f8755db1b198c33c52",
        "b55b5739bcfc191122e4249ca88fd502",
        "c13f45eb6f6ea48b718436651bf73c9a",
        "d0df24224e61db58be8dfdc837eacc7f",
        "e9b943dd67073e83c59c376d6d1156b7",
    ],
    "Artistic-1.0-Perl": [
        "01297679267ad921516667ccd889865e",
    ],
    "BSD-2-Clause": [
        "1119ab2d49fc2aeb18a141efc2f85892",
        "1861aa5e650030a606b82b2f8d390297",
        "22a6f96a3c74b763e77c745efc42c9dc",
        "2d3990a60f70f5b045818bad621367ed",
        "38940bf3a38e8d7cfbe81768e3b05669",
        "3a1465ab6cc0fd2f6545d312e1360389",
        "570d62b8a49361b54b7dafa561e3804e",
        "6222f053df59426503c9f9be59942726",
        "7156097767f5afef1724228b3dfb48fe",
        "78e68664ee501c7077c00b6d2ffa1ffa",
        "8c19b192342f336853fe3904a8a03dc0",
        "a7416d4301b525f30f09fc2ac1ffd2c5",
        "b0538ec125cafeeb58bf11083985630b",
        "b0d8a355d76e39b16dea88aff74a9447",
        "c68d9ff1c0c6464af2938d8e19d9fd7b",
        "c8d9da4700de1066e5677793245d6601",
        "f25adee33b56a84400ef49514e1ac4d0",
    ],
    "BSD-3-Clause": [
        "052deb709028002fa22667938ca0127f",
        "171bd32489c97052dbf70c3cc20672d9",
        "22d101e755b8a71e8a1110668d841dd5",
        "28d69e522b95ee52225df8b4857bae97",
        "2d52a0b8a67ff571b2f84075cc819e30",
        "327fc7dce6600bcd21c8ecdfbb70d159",
        "33b6e5fc53dd2295126edfa2430d5ca2",
        "39011f2cfba3de29f89b78678ca27307",
        "48005e9538a2352dc90a54676bb36540",
        "68cd15dfd08ed147883f88ee77783484",
        "6a0bc66ae812e3591663af770f6e1ca7",
        "75247bfc5addf7d69016385291098df5",
        "80d5b9947e8182f490c0e3fbd7990175",
        "8c7d4b778f7a169b9de6636bb71882a8",
        "8e4623ea519f3d2b0efc713e72606b55",
        "90f6744a0f3f1740b4a5aae73c95c5ac",
        "9fea2436538f0f766f50792367f9632e",
        "aa98a9ffa792f5ebca2c6b69d95a6235",
        "ae7a2d2aa2828302508a15d50ea40f6a",
        "bef6389f58256e9608ecc2c766aa48bc",
        "c245a9d439da9a8ea626ab19c280d998",
        "c3d1c7b21056c5f6362e36977fcd2a0b",
        "c48e4023e9c9b2e8974f49cdeffad3bd",
        "ccaea20b3d171ad99478d9f523a35402",
        "cd0c2ba0064534d9261d91dbb5560d23",
        "d4cef4d9ad8054ea8d2cc83477a6f637",
        "d5ec6d92fbede0495e43b68d1adae7df",
        "d7b8e7252a7f0eaa91d55f59b816a38a",
        "dd95cf2a14080325956a1b00756b8f9e",
        "ddcd765ed0a3236bf96e15f76c36983a",
        "dfd9463b7bcad50bb1270be3d6bf0c2a",
        "e29da546e18304100585370a8be32068",
        "e7971ac2ef9e0c61122db0b5f4131087",
        "e82046f0b7f72505ecac75064a0d3ab0",
    ],
    "BSL-1.0": [
        "1a5ac0e1d24e3878eadc3e67ee72af7d",
    ],
    "BlueOak-1.0.0": [
        "3e8824062afab73422504c6031b6342d",
    ],
    "CC-BY-SA-4.0": [
        "b51a46a03c974a82c2f7425a740d6499",
    ],
    "CC0-1.0": [
        "93a180096f6cfcf2c0dd24f75c2eec48",
        "d2a76f70ce19809695b7fb93c6241c23",
    ],
    "GFDL-1.2": [
        "fc8fd4dca9351a1b1ba045c2a7d3d70f",
    ],
    "GFDL-1.3": [
        "3564867804d3e20f9506651fedbca0e9",
    ],
    "GPL-1.0": [
        "21fa8693acc5194a648fe02e11f65a72",
        "738cc3b112640d95d4cd79a58967ecea",
        "dbf3c47f5a8f127e58d08cabc1ebb916",
    ],
    "GPL-2.0": [
        "2093428d61995d672f88578df15ef451",
        "27c2a2d414d0960a8ea0d3941a57dd3b",
        "5e39ace6e62f5a7fe9c17b4da986ad8c",
        "68380dbeadb093b94ecf563db7312db7",
        "a731e56684fe9202ad8f1df5be3645ef",
        "bb7e7527c861092329f5ca43b688d331",
        "caac9b0ab6e25652c5168ed262f1168e",
        "eb1d1ba759e8eee515fb021452d0b32b",
        "f2c06efe640b4a281cbe5337cdde80ab",
    ],
    "GPL-3.0": [
        "0a259049231d1cb48881826c10334723",
        "17e434cc6db7003444b088cb4cc81e91",
        "444f95dc767ede978b60cfb20fbd0bca",
        "5eaa767cc0a56c87c3852144458a3bf1",
        "cbcd0971278be25219f37b6486dcbe3f",
    ],
    "ISC": [
        "459cebc5244bce6de67e5bfd8832fc9d",
        "480a6db2aa8b06bab573b101ff429d10",
        "4cb149653703d948ec6cc9fedc245a5b",
        "5dde91c0dc80f500c8fb89a5c1dee16a",
        "835e051a8d57ded2593a1855767e769c",
        "9b4f6eddda8e34fea1fe9420ebff490a",
        "e8e1ea32eea60e02907d9d691a4153eb",
    ],
    "LGPL-2.0": [
        "74cf7fcef3b29a39165a795b2cad3a3a",
        "97832943be1e344d51af5aee1b658e4f",
        "b2b2c7dac31c74d81c1f4d8da1f08e0b",
        "c396ba2f94537628797123bc12cd2d6e",
    ],
    "LGPL-2.1": [
        "3054b3781b1af43f906dc753acad15ee",
        "35149cc0147209ad0af2abd9b7190399",
        "9cf70f8dddb9a4cb1bedd8de5e1228b7",
        "b36e25b5143e3847c68ef1cc20ba0be7",
        "eaf6afb73fc860a002bfbccbe6f07ce7",
        "f998bc436710cfece156aaa84fd26dd4",
    ],
    "LGPL-3.0": [
        "b31b7335bc37919e8cdd79154e04d88d",
    ],
    "MIT": [
        "267835a5b13808cd084b9abe3f2a1877",
        "5fefeb84c2e262528a30c16c8f8d7a34",
        "66dd1caf442553ce09fa72a9da2e8c0e",
        "87da029a979185feb91a6830e1ade1e9",
    ],
    "MPL-1.1": [
        "9cdb0c94cb45abb55c616e067859d4ad",
    ],
    "MPL-2.0": [
        "7d4b8b0889da3c01eff3fe431102e6d6",
        "d7e5cb5d4031f582f73c7bb44d95d1f6",
    ],
    "NCSA": [
        "a0da08a3467e8127a21d756a5ed37ea9",
    ],
    "OFL-1.1": [
        "db545aa9d6cfb363aba9bb90aa039cf4",
    ],
    "Unicode-3.0": [
        "54046d17efe4d32144d4f78efeafa3d0",
    ],
    "Unlicense": [
        "623ba9db93eda8991a1484472514bff3",
    ],
    "Zlib": [
        "6df2a895c31891fec159c01a49b2d3cf",
        "c8509dae8dc0557bb29ef1c77b16975c",
    ],
}
